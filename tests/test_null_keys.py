"""NULL is a key like any other: no operator loses its rows, at one row per key and at many."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidegrid.operators import compare, episodes, fits, gates, grid, intervals, labels, metrics, profile, splits
from tidegrid.operators.sizing import SALTS, join_keys, keyed_join, lookup_join

START = dt.datetime(2024, 3, 1)
KEYS = ["site"]


@pytest.fixture(scope="module")
def panel(spark):
    rows = [(site, START + dt.timedelta(hours=h), float(h % 5), h % 2, h % 3 == 0) for site in (None, "a") for h in range(19)]
    return spark.createDataFrame(rows, "site string, ts timestamp_ntz, x double, y int, hit boolean")


def groups(df):
    return {r.site for r in df.select("site").distinct().collect()}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_keyed_join_equals_a_null_safe_join(spark, how):
    left = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("b", 4), (None, 1)], "k string, v int")
    right = spark.createDataFrame([(None, 10), ("a", 20), ("a", 21), ("c", 30), (None, 11)], "k string, w int")
    rows = lambda df: sorted(map(str, (tuple(r) for r in df.collect())))
    got, want = keyed_join(left, right, ["k"], how), join_keys(left, right, ["k"], how)
    assert got.columns == want.columns and rows(got) == rows(want)
    assert rows(lookup_join(left, right, ["k"], how)) == rows(want)


def test_keyed_join_refuses_what_would_repeat_rows(spark):
    one = spark.createDataFrame([(None,)], "k string")
    with pytest.raises(ValueError, match="repeat"):
        keyed_join(one, one, ["k"], "full")


def test_full_join_takes_the_key_from_either_side(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2)], "k string, v int")
    right = spark.createDataFrame([(None, 3), ("b", 4)], "k string, w int")
    got = {(r.k, r.v, r.w) for r in join_keys(left, right, ["k"], "full").collect()}
    assert got == {(None, 1, 3), ("a", 2, None), ("b", None, 4)}


def test_hot_null_key_is_dealt_over_parts(spark):
    hot = spark.range(1_000_000).select(F.when(F.col("id") % 3 > 0, F.lit("a")).alias("site"), F.col("id").alias("v"))
    side = spark.createDataFrame([(None, 1.0), ("a", 2.0)], "site string, w double")
    joined = keyed_join(hot, side, KEYS)
    assert joined.groupBy("site").agg(F.count("*").alias("n"), F.max("w")).orderBy("site").collect() == [(None, 333_334, 1.0), ("a", 666_666, 2.0)]
    dealt = hot.where("site IS NULL").groupBy(F.pmod(F.xxhash64("v"), F.lit(SALTS)).alias("part")).count()
    assert dealt.count() == SALTS and dealt.agg(F.max("count")).first()[0] < 2 * 333_334 / SALTS


@pytest.mark.parametrize("n", [1, 1_000])
def test_groups_of_any_size_stay(spark, panel, n):
    wide = panel.select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("copy"))
    both = {None, "a"}
    assert groups(profile.outlier_candidates(wide, KEYS, "x")) == both
    assert groups(metrics.effective_size(wide, KEYS, "x")) == both
    assert groups(metrics.top_share_flag(wide, KEYS, "x", 0.2, "top")) == both
    audit = profile.grid_audit(wide.where("x <> 2"), KEYS, "ts").collect()
    assert {r.site for r in audit} == both and all(r.first_missing for r in audit)
    active = grid.ever_active(wide, KEYS, "ts", ["x"])
    assert active.count() == wide.count() and active.agg(F.min("x__active")).first()[0] == 1
    scores = {r.site: (r.roc_auc, r.average_precision, r.alert_precision) for r in metrics.binary_scores(wide.withColumn("p", F.col("x") / 5), KEYS, "p", "y", "hit").collect()}
    assert scores[None] == scores["a"] and None not in scores[None]


def test_events_intervals_and_labels_of_the_null_series(panel):
    events = panel.where("hit").select("site", F.col("ts").alias("start"))
    found = intervals.next_event(panel, events, KEYS, "ts", "start", 180)
    assert found.count() == panel.count()
    assert {r.site: r.n for r in found.groupBy("site").agg(F.count("next_start").alias("n")).collect()} == {None: 18, "a": 18}
    held = intervals.within(panel, events.withColumn("end", F.col("start") + F.expr("INTERVAL 1 HOUR")), KEYS, "ts", "start", "end")
    assert {r.site: r["count"] for r in held.groupBy("site").count().collect()} == {None: 13, "a": 13}
    whole = grid.complete_grid(panel.where("x <> 2"), KEYS, "ts", 60)
    assert {r.site: (r.n, r.i) for r in whole.groupBy("site").agg(F.count("*").alias("n"), F.sum("inserted").alias("i")).collect()} == {None: (19, 4), "a": (19, 4)}
    long = labels.supervised_long(panel.select("site", F.col("ts").alias("origin")), panel, KEYS, [120], "x", 60)
    assert {r.site: r["count"] for r in long.groupBy("site").count().collect()} == {None: 18, "a": 18}


def test_fits_and_profiles_of_the_null_series(panel):
    holes = panel.withColumn("x", F.when(F.col("x") != 3, F.col("x")))
    assert fits.fill_medians(panel, holes, KEYS, ["x"]).where("x IS NULL").count() == 0
    scaler = fits.robust_scaler(panel, KEYS, ["x"])
    assert groups(scaler) == {None, "a"} and fits.apply_scaler(panel, scaler, KEYS, ["x"]).count() == 38
    table = fits.fit_profile(panel, KEYS, "ts", "x", F.hour("ts"))
    looked = fits.lookup_profile(panel, table, KEYS, "ts", F.hour("ts"), "m")
    assert looked.count() == 38 and looked.where("m IS NULL").count() == 0
    assert {r.site: r["count"] for r in splits.recent_window(panel, KEYS, "ts", 5, 60).groupBy("site").count().collect()} == {None: 5, "a": 5}
    model = fits.fit_linear(panel.withColumn("z", F.col("x") * 2 + 1), KEYS, ["x"], "z")
    assert fits.predict_linear(panel, model, KEYS, ["x"], "p").where("abs(p - 2 * x - 1) < 1e-9").count() == 38


def test_differences_and_gates_match_null_with_null(spark, panel):
    diff = compare.table_diff(panel, panel, ["site", "ts"], ["x"]).first()
    assert (diff.shared_cells, diff.only_left, diff.only_right) == (38, 0, 0)
    overlap = compare.boundary_overlap(panel, panel, ["site", "ts"]).first()
    assert (overlap.overlap_rows, overlap.identical_rows) == (38, 38)
    table = spark.createDataFrame([(v, "overall", None, None, None, None, None, a) for v, a in (("base", 0.5), ("new", 0.75))],
                                  "variant string, scope string, fold_id string, horizon_bucket string, origin_regime string, target_in_event boolean, target_episode_id string, accuracy_1_minus_mape double")
    assert gates.gains_against(table, "base", ["near", "far"], []).first().overall_accuracy_gain_pct == 25.0


def test_leave_one_out_and_auc_of_the_null_group(panel):
    got = {r.site: r.acc for r in episodes.leave_one_out_accuracy(panel, KEYS, "x", "y", "acc").collect()}
    assert set(got) == {None, "a"} and got[None] == got["a"]
