import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegrid.functions import blend, horizons
from tidegrid.functions.timeline import as_instant, as_wall_clock, epoch_micros
from tidegrid.operators import checks, compare, episodes, fits, gates, intervals, labels, metrics, profile, splits
from tidegrid.sources import reshape


def test_horizon_buckets_are_right_closed(frame):
    df = frame([(h,) for h in (15, 120, 135, 360, 375, 720, 735, 1440)], "h int")
    got = [r.b for r in df.select(horizons.horizon_bucket("h").alias("b")).collect()]
    assert got == [b for b in ("h015_120", "h135_360", "h375_720", "h735_1440") for _ in range(2)]


def test_off_grid_horizon_fails(frame):
    df = frame([("2025-01-01 00:00:00", 20)], "origin timestamp_ntz, horizon_minutes int")
    with pytest.raises(Exception, match="off the interval grid"):
        df.select(horizons.interval_bounds("origin", "horizon_minutes", 15)["interval_start"]).collect()


def test_wall_clock_round_trip_does_not_depend_on_the_session_zone(frame, spark):
    df = frame([("2025-03-30 02:30:00.123456",)], "ts timestamp_ntz")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        row = df.select(epoch_micros("ts").alias("m"), as_wall_clock(as_instant("ts")).cast("string").alias("t")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert row.t == "2025-03-30 02:30:00.123456" and row.m == 1743301800123456


def cells(frame):
    rows = [("m", "long", "f1", "a", 15, 100.0, 110.0), ("m", "long", "f1", "a", 30, 200.0, 180.0),
            ("m", "long", "f2", "b", 15, 0.0, 5.0), ("m", "long", "f2", "b", 30, 50.0, 55.0),
            ("m", "long", "f2", "b", 30, None, 1.0), ("m", "long", "f2", "b", 30, 10.0, float("nan"))]
    return frame(rows, "model string, period string, fold_id string, target string, horizon_minutes int, actual double, prediction double")


def test_strict_and_lenient_metrics_treat_zeros_differently(frame):
    df = cells(frame)
    strict = df.agg(*metrics.strict_errors()).first()
    assert strict.mape == pytest.approx(0.1)
    assert (strict.valid_count, strict.zero_actual_count, strict.missing_actual_count, strict.missing_prediction_count) == (3, 1, 1, 1)
    lenient = df.agg(*metrics.lenient_errors()).first()
    assert lenient.mae == pytest.approx((10 + 20 + 5 + 5) / 4) and lenient.mape == pytest.approx(0.1)


def test_rollup_is_pooled(frame):
    out = metrics.summarize_forecasts(cells(frame)).collect()
    assert {r.scope for r in out} == {"overall", "target", "fold_target", "target_horizon"}
    overall = [r for r in out if r.scope == "overall"][0]
    assert overall.mape == pytest.approx(0.1) and overall.target == "all" and overall.valid_count == 3
    assert len([r for r in out if r.scope == "target_horizon"]) == 4


def test_scan_finds_the_best_weight(frame):
    df = frame([(100.0, 80.0, 120.0), (50.0, 40.0, 60.0)], "actual double, control double, candidate double").withColumn("g", F.lit(1))
    best = metrics.scan_weights(df, ["g"], [i / 20 for i in range(21)], lambda w: F.col("control") * (1 - w) + F.col("candidate") * w).first()
    assert best.best_weight == 0.5 and best.best_mape == pytest.approx(0.0, abs=1e-12)


def test_blends_and_caps(frame):
    row = lambda c: frame([(1,)], "i int").select(c.alias("v")).first().v
    lit = lambda v: F.lit(float(v))
    assert row(blend.convex(lit(10), lit(14), 0.25)) == 11 and row(blend.convex(lit(20), lit(12), 0.25)) == 18
    assert row(blend.symmetric_cap(lit(100), lit(140), 15)) == 115 and row(blend.symmetric_cap(lit(100), lit(60), 15)) == 85
    mix = {"a": (lit(100), 0.6, 0.3), "b": (lit(100), 0.4, 0.7)}
    assert row(blend.gated_mixture(F.lit(1), mix, 32, lit(0.8), 0.2, 0.7, 1.2)) == pytest.approx(100)
    assert row(blend.gated_mixture(F.lit(1), mix, 32, lit(1.21), 0.2, 0.7, 1.2)) == pytest.approx(120)
    assert row(blend.uninvert_blend(blend.convex(lit(7), lit(3), 0.4), lit(3), 0.4)) == pytest.approx(7)
    assert row(F.bround(F.lit(2.5), 0)) == 2
    b = blend.project_bounds(lit(50), lit(30), 200, 440)
    assert row(b["part"]) == 30 and row(blend.project_bounds(lit(50), lit(30), 200, 440, repair="raise_total")["total"]) == 50


def test_trajectories_and_wide_long(frame):
    y = frame([("s", f"2025-01-01 00:{m:02d}:00", v) for m, v in zip((0, 15, 30, 45), (10.0, 20.0, 30.0, None))],
              "series_id string, ts timestamp_ntz, x double")
    o = frame([("s", "2025-01-01 00:00:00"), ("s", "2025-01-01 00:15:00")], "series_id string, origin timestamp_ntz")
    c = labels.supervised_long(o, y, ["series_id"], [15, 30, 45], "x", 15, how="left")
    t = labels.trajectories(c, ["series_id"], [15, 30, 45])
    assert [r.trajectory for r in t.orderBy("origin").collect()] == [[10, 20, 30], [20, 30, None]]
    assert labels.complete_trajectories(t).count() == 1
    f = c.withColumn("prediction", F.col("actual"))
    wide = reshape.to_wide(f, ["series_id", "origin"], ["x"], [15, 30, 45])
    assert wide.columns == ["series_id", "origin", "x_t+15_pred", "x_t+30_pred", "x_t+45_pred"]
    back = reshape.to_long(wide, ["series_id", "origin"], wide.columns[2:])
    assert compare.same_rows(back, f.select(*back.columns)).count() == 0


EPISODES = [("s", "e1", "2025-01-02 00:00:00", "2025-01-03 12:00:00"), ("s", "e2", "2025-01-04 00:00:00", "2025-01-04 06:00:00")]
EPISODE_SCHEMA = "series_id string, episode_id string, episode_start timestamp_ntz, episode_end timestamp_ntz"


def test_event_context_later_episode_wins(frame):
    eps = frame(EPISODES, EPISODE_SCHEMA)
    times = ["2025-01-01 00:00:00", "2024-12-31 23:59:00", "2025-01-02 00:00:00", "2025-01-03 12:00:00", "2025-01-03 13:00:00", "2025-01-05 06:00:00", "2025-01-05 06:01:00"]
    x = frame([("s", t, t) for t in times], "series_id string, origin timestamp_ntz, interval_start timestamp_ntz")
    got = {str(r.origin): (r.origin_regime, r.origin_episode_id, r.target_in_event) for r in intervals.attach_event_context(x, eps, ["series_id"], 24).collect()}
    assert [got[t] for t in times] == [("pre_event", "e1", False), ("ordinary", "", False), ("active_event", "e1", True),
                                       ("pre_event", "e2", True), ("pre_event", "e2", False), ("recovery", "e2", False), ("ordinary", "", False)]


def test_next_event_is_strict_then_inclusive(frame):
    eps = frame([("s", "2025-01-01 10:00:00"), ("s", "2025-01-20 00:00:00")], "series_id string, start timestamp_ntz")
    times = ["2025-01-01 07:59:59", "2025-01-01 08:00:00", "2025-01-01 09:59:59", "2025-01-01 10:00:00"]
    pts = frame([("s", t) for t in times], "series_id string, ts timestamp_ntz")
    out = intervals.next_event(pts, eps, ["series_id"], "ts", "start", 120).orderBy("ts").collect()
    assert [r.next_start is not None for r in out] == [False, True, True, False]


def test_alert_detection_window(frame):
    p = frame([("s", "2025-01-01 23:00:00", 1, 0.9), ("s", "2025-01-02 00:00:00", 1, 1.0), ("s", "2025-01-01 20:00:00", 1, 0.7), ("s", "2025-01-01 21:00:00", 0, 0.1)],
              "series_id string, origin timestamp_ntz, alert int, probability double")
    rows = {r.episode_id: r for r in intervals.alert_detection(p, frame(EPISODES, EPISODE_SCHEMA), ["series_id"], 240).collect()}
    assert (rows["e1"].window_rows, rows["e1"].alert_rows, rows["e1"].earliest_lead_hours, rows["e1"].maximum_probability) == (3, 2, 4.0, 0.9)
    assert rows["e2"].window_rows == 0 and rows["e2"].detected is False and rows["e2"].alert_fraction is None


def test_event_days_and_episodes(frame):
    times = pd.date_range("2025-01-01", periods=480, freq="15min")
    low = {"2025-01-02 10:00:00": 0.7, "2025-01-03 10:00:00": 0.6, "2025-01-05 10:00:00": 0.75}
    df = frame([("s", str(t), low.get(str(t), 1.0)) for t in times], "series_id string, ts timestamp_ntz, ratio double")
    days = episodes.event_days(df, ["series_id"], "ts", "ratio", 0.8)
    eps = episodes.merge_days(days, ["series_id"]).orderBy("episode_start").collect()
    assert days.count() == 3 and [e.event_day_count for e in eps] == [2, 1]
    assert eps[0].min_ratio == 0.6 and eps[0].member_event_day_ids == "s_day_01|s_day_02"


def test_outcome_classes(frame):
    df = frame([("a", -9.0, -8.0, -9.0, 1.0), ("b", -9.0, 2.0, None, None)], "episode_id string, future_2h_mean_change double, future_6h_mean_change double, future_12h_mean_change double, future_24h_mean_change double")
    out = {r.episode_id: r for r in episodes.outcome_classes(df, -5).collect()}
    assert out["a"].sustained_drop_6h and out["a"].rebound_by_24h and not out["b"].sustained_drop_6h and not out["b"].rebound_by_24h


def test_folds_and_layout(spark, frame):
    folds = [splits.Fold("f1", "2025-01-09 23:45:00", "2025-01-10 00:00:00", "2025-01-10 23:45:00"),
             splits.Fold("f2", "2025-01-10 12:00:00", "2025-01-10 23:45:00", "2025-01-11 23:30:00")]
    table = splits.fold_table(spark, folds)
    a = splits.assignments(table, 15, [15, 1440], 1)
    assert a.filter("fold_id = 'f1'").count() == 96 and splits.layout_problems(a, 15).count() == 0
    latest = a.filter("fold_id = 'f1'").first().latest_train_origin
    assert str(latest) == "2025-01-08 23:45:00"
    lay = {r.fold_id: r for r in splits.block_layout(table, splits.fold_table(spark, []), 15, 96).collect()}
    assert lay["f1"].shared_origins == 1 and not lay["f1"].layout_ok
    assert [tuple(r) for r in splits.expanding_pairs(spark, folds).collect()] == [("f2", "f1")]


def test_grouped_folds_keep_days_whole(frame):
    df = frame([(f"d{i}", j, int(i < 6)) for i in range(20) for j in range(5)], "day string, j int, y int")
    out = splits.grouped_folds(df, "day", "y", 3, 1)
    assert out.groupBy("day").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0
    assert sorted(r.n for r in out.filter("y = 1").groupBy("fold").agg(F.count_distinct("day").alias("n")).collect()) == [2, 2, 2]


def test_grouped_least_squares_and_rank_deficiency(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (200, 2))
    y = 3 + x @ [2.0, -1.0] + rng.normal(0, 0.1, 200)
    df = spark.createDataFrame([(i % 2, float(a), float(b), float(a), float(t)) for i, ((a, b), t) in enumerate(zip(x, y))], "g int, a double, b double, c double, y double")
    for r in fits.fit_linear(df, ["g"], ["a", "b"], "y").collect():
        part = np.arange(200) % 2 == r.g
        want, *_ = np.linalg.lstsq(np.column_stack([x[part], np.ones(part.sum())]), y[part], rcond=None)
        np.testing.assert_allclose([r.beta_a, r.beta_b, r.intercept], want, atol=1e-8)
    twin = fits.fit_linear(df, ["g"], ["a", "c"], "y").first()
    assert twin.beta_a == pytest.approx(twin.beta_c)
    l1 = fits.fit_weighted_l1(df.withColumn("y", F.when(F.col("a") > 2, 900.0).otherwise(F.col("y"))).withColumn("w", F.lit(1.0)), ["a", "b"], "y", "w", rounds=8).first()
    assert l1.beta_b == pytest.approx(-1, abs=0.15)


def test_robust_scaler_imputes_with_the_library_median(frame):
    lib = frame([(1.0, None), (2.0, 10.0), (3.0, 20.0)], "a double, b double").withColumn("g", F.lit(1))
    scaler = fits.robust_scaler(lib, ["g"], ["a", "b"])
    assert {r.column_name: r.center for r in scaler.collect()} == {"a": 2.0, "b": 15.0}
    q = frame([(4.0, None)], "a double, b double").withColumn("g", F.lit(1))
    row = fits.apply_scaler(q, scaler, ["g"], ["a", "b"]).first()
    assert row.b == 0 and row.a == 2.0


def test_support_shift_edge_cases(frame):
    df = frame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, b double")
    empty = frame([(None, 9.0), (None, 5.0)], "a double, b double")
    out = {r.column_name: r for r in profile.support_shift(df, df, empty, ["a", "b"]).collect()}
    assert out["a"].test_missing_rate == 1.0 and out["a"].out_of_support_rate is None
    assert out["b"].median_shift_in_reference_iqr is None and out["b"].hard_above_rate == 0.5


def test_grid_audit_reports_gaps(frame):
    df = frame([("s", f"2025-01-01 {t}") for t in ("00:00:00", "00:15:00", "00:30:00", "01:30:00", "01:40:00")], "series_id string, ts timestamp_ntz")
    r = profile.grid_audit(df, ["series_id"], "ts", shown=2).first()
    assert (r.modal_step, r.gap_count, r.missing_points, r.off_step_count) == (15, 1, 3, 2)
    assert r.first_missing == "2025-01-01 00:45|2025-01-01 01:00"


def test_promotion_gate_needs_every_check(frame):
    base = {"fold_id": "all", "horizon_bucket": "all", "origin_regime": "all", "target_in_event": "all", "target_episode_id": "all"}
    def row(scope, variant, acc, **at):
        return (scope, variant, *{**base, **at}.values(), acc)
    rows = [row("overall", v, a) for v, a in (("control", .80), ("good", .82), ("bad", .70))]
    for v, a in (("control", .8), ("good", .81), ("bad", .8)):
        rows += [row("origin_regime", v, a, origin_regime="ordinary"), row("fold", v, a, fold_id="f2"), row("episode", v, a, target_episode_id="e")]
        rows += [row("horizon_bucket", v, a, horizon_bucket=b) for b in ("near", "far")]
    df = frame(rows, "scope string, variant string, fold_id string, horizon_bucket string, origin_regime string, target_in_event string, target_episode_id string, accuracy_1_minus_mape double")
    out = {r.variant: r for r in gates.promotion_gate(df, "control", ["near", "far"], ["f2"], min_gain=0.5, max_ordinary_loss=0.5).collect()}
    assert out["good"].promotion_gate_passed and out["good"].overall_accuracy_gain_pct == pytest.approx(2.0)
    assert not out["bad"].promotion_gate_passed and not out["bad"].pass_episodes


def test_result_contract_counts(frame):
    df = frame([("s", 1, 5.0, 3.0), ("s", 2, -1.0, 9.0), ("s", 2, float("nan"), 9.0)], "series_id string, h int, part double, total double")
    want = frame([("s", 1), ("s", 3)], "series_id string, h int")
    got = {r.problem: r.detail for r in checks.result_contract(df, want, ["series_id", "h"], "part", "total", part_max=10, total_max=10).collect()}
    assert got["part_above_total"] >= 1 and got["negative"] == 1 and got["not_finite"] == 1
    assert (got["missing_keys"], got["unexpected_keys"], got["duplicate_keys"]) == (1, 2, 1)


def test_optimal_scale_minimises_relative_error(frame):
    rng = np.random.default_rng(6)
    a, p = rng.uniform(10, 100, 41), rng.uniform(10, 100, 41)
    df = frame([(float(x), float(y)) for x, y in zip(a, p)], "actual double, prediction double").withColumn("g", F.lit(1))
    scale = metrics.optimal_scale(df, ["g"], "actual", "prediction", "scale").first().scale
    cost = lambda s: np.mean(np.abs(s * p - a) / a)
    assert cost(scale) <= min(cost(s) for s in np.linspace(0.05, 5, 3000)) + 1e-9 and not math.isnan(scale)


@pytest.mark.parametrize("weight", [None, "w"])
def test_least_squares_far_from_zero_keeps_its_digits(spark, weight):
    from tidegrid.operators import fits
    dice = np.random.default_rng(4)
    z, w = dice.normal(size=2000), dice.uniform(0.5, 2, 2000)
    rows = [(str(i % 2), float(1e9 + v), float(3 * v - 7), float(k)) for i, (v, k) in enumerate(zip(z, w))]
    df = spark.createDataFrame(rows, "g string, x double, y double, w double")
    for r in fits.fit_linear(df, ["g"], ["x"], "y", weight).collect():
        assert r.beta_x == pytest.approx(3, rel=1e-6)
        assert r.intercept + r.beta_x * 1e9 == pytest.approx(-7, abs=1e-5)
