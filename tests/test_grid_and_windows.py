import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import checks, chunks, features, grid, labels, reconcile


def column(df, name, order="ts"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_interval_mean_needs_every_sample(minutes):
    base = minutes(range(1440))
    table = labels.interval_means(base, ["series_id"], "ts", ["x"], 15, 15)
    got = {str(r.ts): r.x for r in table.collect()}
    assert got["2025-01-01 10:00:00"] == np.mean(range(600, 615))
    gap = labels.interval_means(base.filter("x <> 7"), ["series_id"], "ts", ["x"], 15, 15)
    first = gap.orderBy("ts").first()
    assert first.x is None and first.x__complete is False


def test_grid_completion_flags_and_activity(frame):
    df = frame([("s", "2025-01-01 00:00:00", 1.0, None), ("s", "2025-01-01 00:02:00", 3.0, 6.0)],
               "series_id string, ts timestamp_ntz, a double, partial double")
    full = grid.complete_grid(df, ["series_id"], "ts", 1)
    assert column(full, "inserted") == [0, 1, 0]
    assert column(grid.ever_active(full, ["series_id"], "ts", ["partial"]), "partial__active") == [0, 0, 1]


def test_grid_is_complete_across_chunk_borders(frame):
    df = frame([("s", "2025-01-01 00:07:00"), ("s", "2025-01-03 05:37:00")], "series_id string, ts timestamp_ntz")
    full = grid.complete_grid(df, ["series_id"], "ts", 15, chunk=1440)
    assert full.count() == full.distinct().count() == (53 * 60 + 30) // 15 + 1


def test_duplicate_key_and_clashing_columns_are_refused(minutes):
    df = minutes([1, 2])
    with pytest.raises(Exception, match="repeats a key"):
        grid.join_families({"a": df.unionByName(df)}, ["series_id", "ts"]).count()
    with pytest.raises(ValueError, match="occurs in"):
        grid.join_families({"a": df, "b": df}, ["series_id", "ts"])


def test_forward_fill_equals_pandas_limit(minutes):
    rng = np.random.default_rng(3)
    values = [None if rng.random() < 0.6 else float(i) for i in range(400)]
    got = column(grid.forward_fill(minutes(values), ["series_id"], "ts", ["x"], 4, 1), "x")
    want = pd.Series(values, dtype=float).ffill(limit=4)
    assert [None if pd.isna(v) else v for v in want] == got


@pytest.mark.parametrize("rows", [24, 96])
def test_chunked_windows_equal_one_global_window(minutes, rows):
    rng = np.random.default_rng(5)
    values = [None if rng.random() < 0.2 else float(rng.normal(100, 20)) for _ in range(900)]
    values[300:420] = [42.0] * 120
    feats = [features.rolling("x", rows, k, 5) for k in ("mean", "std_pop", "std_samp")] + [features.lag("x", 95)]
    df = minutes(values, step=15)
    small = features.build_features(df, ["series_id"], "ts", 15, feats, chunk=rows * 15 * 2).orderBy("ts").toPandas()
    s = pd.Series(values, dtype=float)
    roll = s.rolling(rows, min_periods=5)
    for name, want in ((f"x__mean_{rows}", roll.mean()), (f"x__std_pop_{rows}", roll.std(ddof=0)),
                       (f"x__std_samp_{rows}", roll.std()), ("x__lag_95", s.shift(95))):
        np.testing.assert_allclose(small[name].to_numpy(float), want.to_numpy(float), atol=1e-6, equal_nan=True)


def test_dwell_equals_capped_loop(minutes):
    rng = np.random.default_rng(8)
    zone = [int(v) for v in rng.random(300) < 0.8]
    df = minutes(zone).withColumn("zone", F.col("x").cast("int"))
    got = column(features.build_features(df, ["series_id"], "ts", 1, features.dwell("zone", 5, "dwell"), chunk=40), "dwell")
    want, n = [], 0
    for z in zone:
        n = min(n + 1, 5) if z else 0
        want.append(n)
    assert got == want


def test_low_level_ratio_chains_two_frames(minutes):
    values = list(np.random.default_rng(2).uniform(50, 150, 500))
    spec = features.low_level_ratio("x", 4, 72, 24, "ratio")
    got = column(features.build_features(minutes(values), ["series_id"], "ts", 1, spec, chunk=200), "ratio")
    smooth = pd.Series(values).rolling(4, min_periods=1).mean()
    want = smooth / smooth.rolling(72, min_periods=24).mean()
    np.testing.assert_allclose(np.array(got, float), want.to_numpy(), atol=1e-9, equal_nan=True)


@pytest.mark.parametrize("spec", [
    [features.lag("x", 2)], [features.rolling("x", 40, "mean", 3)], [*features.window_delta("x", 6)],
    [*features.low_level_ratio("x", 4, 40, 10, "ratio")], [*features.mean_difference("x", 5)],
    [features.missing_fraction("x", 8)]])
def test_future_changes_never_reach_the_past(minutes, spec):
    df = minutes(list(np.random.default_rng(1).uniform(0, 9, 120)))
    names = [f.name for f in spec]
    op = lambda d: features.build_features(d, ["series_id"], "ts", 1, spec, chunk=50).select("ts", *names)
    cut = F.lit("2025-01-01 01:00:00").cast("timestamp_ntz")
    assert checks.future_change(op, df, "ts", cut, ["x"]).count() == 0


def test_registry_problems_and_selection(spark):
    feats = [features.lag("a", 1), features.shifted_label("y"), features.rolling("b", 4, "mean")]
    reg = features.registry(spark, feats, 15, calendar=True)
    assert {(r.feature_name, r.problem) for r in checks.registry_problems(reg).collect()} == {("y__previous_interval", "diagnostic")}
    chosen = features.select_features(reg, ["a"], ["lag"])
    assert features.selected_names(chosen, ["a"]) == ["a__lag_1"]
    with pytest.raises(ValueError):
        features.selected_names(chosen, ["a", "b"])


def test_previous_moment_over_any_gap(frame):
    times = ["2025-01-01 00:00:00", "2025-01-01 00:15:00", "2025-06-01 00:00:00", "2025-06-01 00:15:00"]
    df = frame([("s", t) for t in times], "series_id string, ts timestamp_ntz")
    got = column(chunks.adjacent(df, ["series_id"], "ts", "before", length=1440), "before")
    assert [None if v is None else str(v) for v in got] == [None, *times[:-1]]


def test_overlap_reconciliation_uses_its_own_output_and_restarts_at_gaps(frame):
    def cell(t, h, v):
        return ("s", f"2025-01-01 {t}", h, v)
    df = frame([cell("00:00:00", 45, 10.0), cell("00:15:00", 30, 20.0), cell("00:30:00", 15, 40.0),
                cell("02:00:00", 45, 1.0), cell("02:30:00", 15, 3.0)],
               "series_id string, origin timestamp_ntz, horizon_minutes int, prediction double")
    out = reconcile.overlap_reconcile(df, ["series_id"], 0.5, 15)
    got = {str(r.origin)[11:16]: r.reconciled for r in out.collect()}
    assert got == {"00:00": 10.0, "00:15": 15.0, "00:30": 27.5, "02:00": 1.0, "02:30": 3.0}


def test_recursive_rollout_equals_loop(frame, spark):
    history = [5.0, 7.0, 6.0, 8.0]
    df = spark.createDataFrame([(1, history, 1.0, 0.5, 0.2, 0.1)],
                               "id int, history array<double>, intercept double, beta_lag_1 double, beta_lag_2 double, beta_mean double")
    got = reconcile.recursive_rollout(df, "history", 5, (1, 2), 3).first().path
    past, want = list(history), []
    for _ in range(5):
        v = max(0.0, 1.0 + 0.5 * past[-1] + 0.2 * past[-2] + 0.1 * np.mean(past[-3:]))
        past.append(v)
        want.append(v)
    np.testing.assert_allclose(got, want)


def test_sequence_windows_need_full_history(minutes):
    out = features.sequence_window(minutes(range(6)), ["series_id"], "ts", ["x"], 4, 1)
    assert [[v.x for v in r.window_values] for r in out.orderBy("ts").collect()] == [[0, 1, 2, 3], [1, 2, 3, 4], [2, 3, 4, 5]]


def test_contiguous_union_refuses_a_gap(minutes):
    a, b = minutes([1, 2]), minutes([3, 4], start="2025-01-01 00:02:00")
    assert grid.contiguous_union(a, b, ["series_id"], "ts", 1).count() == 4
    late = minutes([3, 4], start="2025-01-01 00:05:00")
    with pytest.raises(Exception, match="not contiguous"):
        grid.contiguous_union(a, late, ["series_id"], "ts", 1).collect()


@pytest.mark.parametrize("rows", [1, 31, 32, 200])
@pytest.mark.parametrize("odd", [None, float("nan"), float("inf"), 1e17])
def test_a_bad_value_is_forgotten_when_it_leaves_the_frame(minutes, rows, odd):
    from tidegrid.operators.features import build_features, rolling
    rng = np.random.default_rng(3)
    values = (rng.normal(50, 2, 420)).round(3).tolist()
    values[5] = odd
    df = minutes(values)
    spec = [rolling("x", rows, kind, minimum=1, label=kind) for kind in ("mean", "std_pop", "std_samp", "sum", "min", "max")]
    got = build_features(df, ["series_id"], "ts", 1, spec).toPandas().sort_values("ts").reset_index(drop=True)
    series = pd.Series([np.nan if v is None or not np.isfinite(v) else v for v in values])
    for i in (4, 90, 210, 300, 419):
        part = series[max(0, i - rows + 1) : i + 1].dropna().to_numpy()
        want = {"mean": part.mean(), "std_pop": part.std(), "sum": part.sum(), "min": part.min(), "max": part.max(),
                "std_samp": part.std(ddof=1) if len(part) > 1 else np.nan}
        for kind, value in want.items():
            assert got[kind][i] == pytest.approx(value, rel=1e-9, nan_ok=True), (kind, i)


@pytest.mark.parametrize("rows", [1, 12, 72, 720])
def test_sliding_order_statistics_equal_pandas(spark, rows):
    from tidegrid.operators.features import build_features, level_vs_baseline, missing_fraction, rolling
    rng = np.random.default_rng(rows)
    n = 1500
    values = np.round(rng.normal(0, 5, n), 1)
    values[rng.random(n) < 0.1] = np.nan
    values[[40, 41, 900]] = np.inf
    times = pd.date_range("2025-01-01", periods=n, freq="min")
    table = [(k, str(t), None if i % 17 == 0 else float(v)) for k in (None, "a") for i, (t, v) in enumerate(zip(times, values))]
    df = spark.createDataFrame(table, "k string, t string, x double").select("k", F.col("t").cast("timestamp_ntz").alias("ts"), "x")
    spec = [rolling("x", rows, kind, minimum=max(1, rows // 3), label=kind) for kind in ("median", "min", "max")]
    spec += [rolling("x", rows, "median", 1, newest=-2, label="late"), missing_fraction("x", rows), level_vs_baseline("x", min(rows, 3), rows, 1)]
    got = build_features(df, ["k"], "ts", 1, spec, chunk=800).toPandas()
    series = pd.Series(np.where(np.arange(n) % 17 == 0, np.nan, np.where(np.isfinite(values), values, np.nan)))
    frame = series.rolling(rows, min_periods=max(1, rows // 3))
    recent = series.rolling(min(rows, 3), min_periods=min(rows, 3)).mean()
    base = series.rolling(rows, min_periods=1).median()
    want = {"median": frame.median(), "min": frame.min(), "max": frame.max(), "late": base.shift(2),
            f"x__missing_fraction_{rows}": series.isna().astype(float).rolling(rows, min_periods=1).mean(),
            f"x__level_vs_{rows}": recent / base.abs().clip(lower=1e-9) - 1}
    for key in (None, "a"):
        own = got[got.k.isna() if key is None else got.k == key].sort_values("ts")
        for name, column in want.items():
            np.testing.assert_allclose(own[name].to_numpy(float), column.to_numpy(float), rtol=1e-9, atol=1e-9, equal_nan=True, err_msg=f"{name} {key}")


def _joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_history_and_grid_join_no_rows(frame):
    """Only one row a series is joined for the check, which no filter on top may lose; the grid needs no join at all."""
    schema = "series_id string, ts timestamp_ntz, x double"
    train = frame([("a", "2025-01-01 00:00:00", 1.0), ("a", "2025-01-01 01:00:00", 2.0)], schema)
    test = frame([("a", "2025-01-01 02:00:00", 3.0), ("b", "2025-01-01 09:00:00", 4.0)], schema)
    both = grid.contiguous_union(train, test, ["series_id"], "ts", 60)
    assert _joins(both) == 1 and both.count() == 4 and both.filter("partition = 'test'").count() == 2
    apart = grid.contiguous_union(train, frame([("a", "2025-01-01 03:00:00", 3.0)], schema), ["series_id"], "ts", 60)
    with pytest.raises(Exception, match="not contiguous"):
        apart.filter("partition = 'test'").collect()
    assert _joins(grid.complete_grid(train, ["series_id"], "ts", 60)) == 0


def test_grid_of_several_pieces_keeps_repeated_rows_and_drops_those_off_the_grid(frame):
    rows = [("a", "2025-01-01 00:00:00", 1.0), ("a", "2025-01-01 00:07:00", 9.0), ("a", "2025-01-01 00:20:30", 9.0), ("a", "2025-01-01 02:00:00", 2.0),
            ("a", "2025-01-01 02:00:00", 3.0), ("a", "2025-01-01 08:20:00", 4.0), (None, "2025-01-01 05:00:00", 5.0)]
    out = grid.complete_grid(frame(rows, "series_id string, ts timestamp_ntz, x double"), ["series_id"], "ts", 20, chunk=50).collect()
    mine = sorted((str(r.ts)[11:16], r.x or 0.0, r.inserted) for r in out if r.series_id == "a")
    assert len(mine) == 27 and [m for m in mine if not m[2]] == [("00:00", 1.0, 0), ("02:00", 2.0, 0), ("02:00", 3.0, 0), ("08:20", 4.0, 0)]
    assert len({m[0] for m in mine}) == 26 and [(r.x, r.inserted) for r in out if r.series_id is None] == [(5.0, 0)]


def test_window_tasks_follow_the_rows(spark, minutes, tmp_path, monkeypatch):
    monkeypatch.setattr(chunks, "TASK_ROWS", 20)
    minutes(range(200), step=60).write.parquet(str(tmp_path / "x"))
    df = spark.read.parquet(str(tmp_path / "x"))
    build = lambda d, **more: features.build_features(d, ["series_id"], "ts", 60, [features.lag("x", 2)], **more)
    assert build(df).rdd.getNumPartitions() == 10 and build(df.filter("x >= 0"), rows=300).rdd.getNumPartitions() == 15
    assert build(df).filter("x__lag_2 = x - 2").count() == 198
