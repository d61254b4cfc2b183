"""Joins, neighbour search, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.functions import horizons as hz
from tidegrid.functions.timeline import epoch_minutes, floor_minutes, on_grid, plus_minutes
from tidegrid.operators import checks, compare, fits, grid, intervals, labels as lab, metrics, neighbors as nn, profile, splits
from tidegrid.operators import features
from tidegrid.operators.sizing import join_keys, keyed_join
from tidegrid.plans import base, events_base as ev
from tidegrid.plans.base import HOUR, KEYS, STEP, sql
from tidegrid.plans.registry import query
from tidegrid.session import cut
from tidegrid.sources import readers, reshape

FOLD_KEYS = ["fold_id", *KEYS]


def order_days(spark, d):
    """Daily order totals; sums as decimals so that equal days compare equal."""
    o = readers.table(spark, d, "orders", ["o_orderdate", "o_totalprice"])
    return o.groupBy(F.col("o_orderdate").alias("ts")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("order_total"),
        F.count(F.lit(1)).cast("double").alias("order_count"))


def line_days(spark, d):
    x = readers.table(spark, d, "lineitem", ["l_shipdate", "l_quantity", "l_extendedprice"])
    return x.groupBy(F.col("l_shipdate").alias("ts")).agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("ship_total"),
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("ship_quantity"))


ORDER_DAYS = "SELECT o_orderdate AS ts, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS order_total, CAST(count(*) AS DOUBLE) AS order_count FROM orders GROUP BY 1"
LINE_DAYS = "SELECT l_shipdate AS ts, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS ship_total, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS ship_quantity FROM lineitem GROUP BY 1"
DAYS = {"od": ORDER_DAYS, "ld": LINE_DAYS}


@query("j1_family_outer_join", "ts:t, order_total:d, order_count:d, ship_total:d, ship_quantity:d",
       sql("SELECT coalesce(od.ts, ld.ts) AS ts, order_total, order_count, ship_total, ship_quantity FROM od FULL JOIN ld ON od.ts = ld.ts", **DAYS))
def family_join(spark, d):
    return grid.join_families({"orders": order_days(spark, d), "lineitem": line_days(spark, d)}, ["ts"])


@query("j2_grid_completion", "series_id:s, ts:t, total:d, inserted:i", sql("SELECT * FROM users", "users"))
def completion(spark, d):
    return base.build_users(spark, d)


@query("j2_daily_grid_completion", "ts:t, ship_total:d, inserted:i",
       sql("""SELECT g.ts, ld.ship_total, CASE WHEN ld.ts IS NULL THEN 1 ELSE 0 END AS inserted
FROM (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL '1 day')) AS ts FROM ld) g LEFT JOIN ld ON ld.ts = g.ts""", ld=LINE_DAYS))
def daily_completion(spark, d):
    rows = line_days(spark, d).withColumn("all", F.lit(0))
    return grid.complete_grid(rows, ["all"], "ts", base.DAY)


@query("j3_origin_horizon_cells", "series_id:s, origin:t, horizon_minutes:i, interval_start:t, target_all__now:d",
       sql(f"""SELECT o.series_id, o.origin, h.horizon_minutes, o.origin + to_minutes(CAST(h.horizon_minutes - {STEP} AS BIGINT)) AS interval_start,
  o.target_all__now FROM origins o CROSS JOIN horizons h""", "origins", "horizons"))
def origin_cells(spark, d):
    x = hz.expand_horizons(base.origins(spark, d), base.HORIZONS)
    return x.withColumn("interval_start", hz.interval_start("origin", "horizon_minutes", STEP))


@query("j4_supervised_cells", "series_id:s, origin:t, horizon_minutes:i, interval_start:t, actual:d",
       sql(f"""SELECT o.series_id, o.origin, h.horizon_minutes, y.ts AS interval_start, y.target_all AS actual FROM origins o CROSS JOIN horizons h
JOIN labels y ON y.series_id = o.series_id AND y.ts = o.origin + to_minutes(CAST(h.horizon_minutes - {STEP} AS BIGINT)) WHERE y.target_all IS NOT NULL""",
           "origins", "horizons", "labels"))
def supervised(spark, d):
    o = base.origins(spark, d).select(*KEYS, "origin")
    return lab.supervised_long(o, base.labels(spark, d), KEYS, base.HORIZONS, "target_all", STEP)


_wide = ", ".join(f"max(CASE WHEN horizon_minutes = {h} THEN actual END) AS target_part_t_{h}" for h in base.HORIZONS)


@query("j5_wide_label_matrix", "series_id:s, origin:t, " + ", ".join(f"target_part_t_{h}:d" for h in base.HORIZONS),
       sql(f"SELECT series_id, origin, {_wide} FROM c GROUP BY 1, 2", "origins", "horizons", "labels",
           c=f"""SELECT o.series_id, o.origin, h.horizon_minutes, y.target_part AS actual FROM origins o CROSS JOIN horizons h
LEFT JOIN labels y ON y.series_id = o.series_id AND y.ts = o.origin + to_minutes(CAST(h.horizon_minutes - {STEP} AS BIGINT))"""))
def wide_matrix(spark, d):
    o = base.origins(spark, d).select(*KEYS, "origin")
    c = lab.supervised_long(o, base.labels(spark, d), KEYS, base.HORIZONS, "target_part", STEP, how="left")
    return lab.wide_labels(c, KEYS, base.HORIZONS, "target_part")


CELL = ["fold_id", *KEYS, "origin", "target", "horizon_minutes"]
PAIRS_SQL = """SELECT a.fold_id, a.series_id, a.origin, a.interval_start, a.target, a.horizon_minutes, a.period, a.actual, a.prediction AS control, b.prediction AS candidate
  FROM forecasts a JOIN forecasts b ON a.model = 'persistence' AND b.model = 'seasonal' AND a.fold_id = b.fold_id AND a.series_id = b.series_id
    AND a.origin = b.origin AND a.target = b.target AND a.horizon_minutes = b.horizon_minutes"""


def pairs(spark, d):
    f = base.forecasts(spark, d)
    return metrics.pair_variants(f, [*CELL, "interval_start", "period"], "persistence", "seasonal")


@query("j6_paired_variants", "fold_id:s, series_id:s, origin:t, target:s, horizon_minutes:i, actual:d, control:d, candidate:d, paired:b",
       sql("SELECT *, control IS NOT NULL AND candidate IS NOT NULL AS paired FROM p", "forecasts", p=PAIRS_SQL))
def paired(spark, d):
    return pairs(spark, d)


@query("j7_origin_score_on_cells", "series_id:s, origin:t, horizon_minutes:i, target:s, model:s, prediction:d, probability:d",
       sql("""SELECT f.series_id, f.origin, f.horizon_minutes, f.target, f.model, f.prediction, h.probability
FROM forecasts f LEFT JOIN hazard h ON h.series_id = f.series_id AND h.origin = f.origin""", "forecasts", "hazard"))
def origin_scores(spark, d):
    score = grid.assert_unique(ev.hazard(spark, d).select(*KEYS, "origin", "probability"), [*KEYS, "origin"],
                               "an origin has two scores")
    return base.forecasts(spark, d).join(score, [*KEYS, "origin"], "left")


CONTEXT_SQL = """SELECT f.*, coalesce(r.regime, 'ordinary') AS origin_regime, coalesce(r.episode_id, '') AS origin_episode_id,
    t.episode_id IS NOT NULL AS target_in_event, coalesce(t.episode_id, '') AS target_episode_id
  FROM forecasts f LEFT JOIN (SELECT series_id, origin, arg_max(regime, episode_start) AS regime, arg_max(episode_id, episode_start) AS episode_id FROM (
      SELECT o.series_id, o.origin, e.episode_id, e.episode_start, CASE WHEN o.origin < e.episode_start THEN 'pre_event'
        WHEN o.origin <= e.episode_end THEN 'active_event' ELSE 'recovery' END AS regime
      FROM (SELECT DISTINCT series_id, origin FROM forecasts) o JOIN episodes e ON e.series_id = o.series_id
        AND o.origin >= e.episode_start - INTERVAL '24 hours' AND o.origin <= e.episode_end + INTERVAL '24 hours') GROUP BY 1, 2) r
    ON r.series_id = f.series_id AND r.origin = f.origin
  LEFT JOIN (SELECT i.series_id, i.interval_start, arg_max(e.episode_id, e.episode_start) AS episode_id
      FROM (SELECT DISTINCT series_id, interval_start FROM forecasts) i JOIN episodes e ON e.series_id = i.series_id
        AND i.interval_start BETWEEN e.episode_start AND e.episode_end GROUP BY 1, 2) t
    ON t.series_id = f.series_id AND t.interval_start = f.interval_start"""


def in_context(spark, d):
    return intervals.attach_event_context(base.forecasts(spark, d), ev.episodes(spark, d), KEYS, 24)


@query("j8_event_context", "model:s, series_id:s, origin:t, interval_start:t, target:s, horizon_minutes:i, origin_regime:s, origin_episode_id:s, target_in_event:b, target_episode_id:s",
       sql("SELECT * FROM c", "forecasts", "episodes", c=CONTEXT_SQL))
def event_context(spark, d):
    return in_context(spark, d)


@query("j9_next_event_within", "event_id:i, next_purchase:t",
       """SELECT v.event_id, min(p.ts) AS next_purchase FROM events v LEFT JOIN events p ON p.event_type = 'purchase' AND p.user_id = v.user_id
  AND p.ts > v.ts AND p.ts <= v.ts + INTERVAL '24 hours' WHERE v.event_type = 'view' GROUP BY 1""")
def next_purchase(spark, d):
    e = readers.table(spark, d, "events", ["event_id", "user_id", "ts", "event_type"])
    views = e.filter("event_type = 'view'").select("event_id", "user_id", "ts")
    buys = e.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("bought_at"))
    return intervals.next_event(views, buys, ["user_id"], "ts", "bought_at", 1440, "next_purchase")


@query("j9_episode_onset_label", "series_id:s, ts:t, onset:b",
       sql("""SELECT p.series_id, p.ts, count(e.episode_id) > 0 AS onset FROM panel p LEFT JOIN episodes e ON e.series_id = p.series_id
  AND e.episode_start > p.ts AND e.episode_start <= p.ts + INTERVAL '12 hours' GROUP BY 1, 2""", "panel", "episodes"))
def onset(spark, d):
    x = intervals.next_event(base.panel(spark, d).select(*KEYS, "ts"), ev.episodes(spark, d), KEYS, "ts", "episode_start", 720)
    return x.withColumn("onset", F.col("next_start").isNotNull())


FREE_SQL = """SELECT p.series_id, p.ts, p.target_all, p.view FROM panel p WHERE NOT EXISTS (SELECT 1 FROM episodes e WHERE e.series_id = p.series_id
  AND p.ts BETWEEN e.episode_start - INTERVAL '12 hours' AND e.episode_end + INTERVAL '12 hours')"""


@query("j10_outside_event_padding", "series_id:s, ts:t, target_all:d, view:d", sql("SELECT * FROM free", "panel", "episodes", free=FREE_SQL))
def outside(spark, d):
    return intervals.outside_padding(base.panel(spark, d), ev.episodes(spark, d), KEYS, "ts", 12)


LEADS = (2, 6)
CONTROL_SQL = {
    "free": FREE_SQL,
    "event_origins": "SELECT e.series_id, e.episode_id, e.episode_start, l.lead_hours, e.episode_start - to_hours(CAST(l.lead_hours AS BIGINT)) AS origin FROM episodes e CROSS JOIN (SELECT unnest([2, 6]) AS lead_hours) l",
    "matched": """SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY series_id, episode_id, lead_hours) AS control_count FROM (
    SELECT *, row_number() OVER (PARTITION BY series_id, episode_id, lead_hours ORDER BY distance_minutes, control_ts) AS control_rank FROM (
      SELECT *, count(CASE WHEN distance_minutes <= 4 * 1440 THEN 1 END) OVER (PARTITION BY series_id, episode_id, lead_hours) AS near_count FROM (
        SELECT o.*, c.ts AS control_ts, c.target_all AS control_value, abs(epoch(c.ts) - epoch(o.origin)) // 60 AS distance_minutes FROM event_origins o JOIN free c
          ON c.series_id = o.series_id AND extract('hour' FROM c.ts) = extract('hour' FROM o.origin) AND c.ts <> o.origin) WHERE distance_minutes <= 10 * 1440)
    WHERE distance_minutes <= 4 * 1440 OR near_count < 3) WHERE control_rank <= 6) WHERE control_count >= 3""",
}


def matched(spark, d):
    o = intervals.event_origins(ev.episodes(spark, d), LEADS, KEYS)
    free = intervals.outside_padding(base.panel(spark, d), ev.episodes(spark, d), KEYS, "ts", 12)
    return intervals.matched_controls(o, free, KEYS, "ts", near_days=4, far_days=10, at_most=6, at_least=3)


@query("j11_matched_controls", "series_id:s, episode_id:s, lead_hours:i, origin:t, control_ts:t, distance_minutes:i, control_rank:i, control_count:i",
       sql("SELECT * FROM matched", "panel", "episodes", **CONTROL_SQL))
def controls(spark, d):
    return matched(spark, d)


OUTCOME_SPEC = "series_id:s, episode_id:s, past_mean:d, past_median:d, " + ", ".join(
    f"future_{h}h_mean:d, future_{h}h_min:d, future_{h}h_mean_change:d, future_{h}h_min_change:d" for h in (2, 6, 12, 24))
_future = ", ".join(
    f"avg(CASE WHEN p.ts >= e.episode_start AND p.ts < e.episode_start + INTERVAL '{h} hours' THEN p.target_all END) AS future_{h}h_mean, "
    f"min(CASE WHEN p.ts >= e.episode_start AND p.ts < e.episode_start + INTERVAL '{h} hours' THEN p.target_all END) AS future_{h}h_min" for h in (2, 6, 12, 24))
_change = ", ".join(f"future_{h}h_mean - past_mean AS future_{h}h_mean_change, future_{h}h_min - past_mean AS future_{h}h_min_change" for h in (2, 6, 12, 24))
OUTCOME_SQL = f"""SELECT *, {_change} FROM (SELECT e.series_id, e.episode_id, e.episode_start, avg(CASE WHEN p.ts < e.episode_start THEN p.target_all END) AS past_mean,
    quantile_cont(CASE WHEN p.ts < e.episode_start THEN p.target_all END, 0.5) AS past_median, {_future}
  FROM episodes e JOIN panel p ON p.series_id = e.series_id AND p.ts >= e.episode_start - INTERVAL '24 hours' AND p.ts < e.episode_start + INTERVAL '24 hours'
  GROUP BY 1, 2, 3)"""


def outcomes(spark, d):
    return intervals.window_outcomes(ev.episodes(spark, d), base.panel(spark, d), KEYS, "target_all", 24, (2, 6, 12, 24))


@query("j12_event_window_outcomes", OUTCOME_SPEC, sql("SELECT * FROM o", "panel", "episodes", o=OUTCOME_SQL))
def window_outcomes(spark, d):
    return outcomes(spark, d)


@query("j13_alert_detection", "series_id:s, episode_id:s, window_rows:i, alert_rows:i, alert_fraction:d, detected:b, earliest_lead_hours:d, maximum_probability:d",
       sql("""SELECT e.series_id, e.episode_id, count(h.origin) AS window_rows, count(CASE WHEN h.alert = 1 THEN 1 END) AS alert_rows,
  CASE WHEN count(h.origin) > 0 THEN count(CASE WHEN h.alert = 1 THEN 1 END) / count(h.origin) END AS alert_fraction,
  count(CASE WHEN h.alert = 1 THEN 1 END) > 0 AS detected, max(CASE WHEN h.alert = 1 THEN (epoch(e.episode_start) - epoch(h.origin)) / 3600.0 END) AS earliest_lead_hours,
  max(h.probability) AS maximum_probability
FROM episodes e LEFT JOIN hazard h ON h.series_id = e.series_id AND h.origin >= e.episode_start - INTERVAL '24 hours' AND h.origin < e.episode_start GROUP BY 1, 2""",
           "episodes", "hazard"))
def detection(spark, d):
    return intervals.alert_detection(ev.hazard(spark, d), ev.episodes(spark, d), KEYS, 1440)


EMB_SQL = {
    "e": "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings",
    "d": "SELECT a.vec_id AS query_id, b.vec_id AS item_id, b.label AS day, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) / len(a.v)) AS distance FROM e a JOIN e b ON a.vec_id <> b.vec_id",
    "nb": """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) AS neighbor_rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, day ORDER BY distance, item_id) AS k FROM d) WHERE k <= 2 QUALIFY neighbor_rank <= 5""",
}


def embedding_neighbors(spark, d):
    e = readers.table(spark, d, "embeddings")
    return nn.nearest_neighbors(e, e, [], query="vec_id", item="vec_id", vector="embedding", day="label", k=5, per_day=2,
                                skip_self=True)


@query("j14_diverse_nearest_neighbors", "query_id:i, item_id:i, day:i, distance:d, neighbor_rank:i", sql("SELECT * FROM nb", **EMB_SQL))
def knn(spark, d):
    return embedding_neighbors(spark, d)


@query("t3_diverse_top_k", "o_custkey:i, o_orderkey:i, day:i, distance:d, neighbor_rank:i",
       """SELECT o_custkey, o_orderkey, day, distance, neighbor_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY distance, o_orderkey) AS neighbor_rank FROM (
    SELECT *, row_number() OVER (PARTITION BY o_custkey, day ORDER BY distance, o_orderkey) AS k FROM (
      SELECT o_custkey, o_orderkey, extract('year' FROM o_orderdate) AS day, abs(o_totalprice - 150000.0) AS distance FROM orders)) WHERE k <= 1) WHERE neighbor_rank <= 3""")
def diverse_orders(spark, d):
    o = readers.table(spark, d, "orders", ["o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"])
    dist = o.select("o_custkey", "o_orderkey", F.year("o_orderdate").alias("day"), F.abs(F.col("o_totalprice") - 150000.0).alias("distance"))
    return nn.diverse_top_k(dist, ["o_custkey"], "o_orderkey", "day", "distance", 3, 1)


# Analog forecast: origins of the past that looked like now, per site.
_FEATS = ("now", "delta_6", "mean_24")
ANALOG_SQL = {
    "feat": f"""SELECT series_id, ts AS origin, target_all__now AS now, CASE WHEN count(target_all) OVER a = 6 AND count(target_all) OVER b = 6 THEN avg(target_all) OVER a - avg(target_all) OVER b END AS delta_6,
    CASE WHEN count(target_all) OVER c >= 12 THEN avg(target_all) OVER c END AS mean_24 FROM filled
    WINDOW a AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), b AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 11 PRECEDING AND 6 PRECEDING),
      c AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)
    QUALIFY ts = time_bucket(INTERVAL '240 minutes', ts, TIMESTAMP '1970-01-01')""",
    "train": "SELECT f.fold_id, x.* FROM feat x JOIN folds f ON f.role = 'development' AND x.origin + INTERVAL '1380 minutes' <= f.train_end",
    "center": "SELECT fold_id, series_id, quantile_cont(now, 0.5) AS c1, quantile_cont(delta_6, 0.5) AS c2, quantile_cont(mean_24, 0.5) AS c3 FROM train GROUP BY 1, 2",
    "scale": """SELECT t.fold_id, t.series_id, greatest(quantile_cont(coalesce(now, c1), 0.75) - quantile_cont(coalesce(now, c1), 0.25), 1e-6) AS s1,
    greatest(quantile_cont(coalesce(delta_6, c2), 0.75) - quantile_cont(coalesce(delta_6, c2), 0.25), 1e-6) AS s2,
    greatest(quantile_cont(coalesce(mean_24, c3), 0.75) - quantile_cont(coalesce(mean_24, c3), 0.25), 1e-6) AS s3 FROM train t JOIN center c ON c.series_id = t.series_id AND c.fold_id = t.fold_id GROUP BY 1, 2""",
    "scaled": """SELECT c.fold_id, f.series_id, f.origin, (coalesce(now, c1) - c1) / s1 AS now, (coalesce(delta_6, c2) - c2) / s2 AS delta_6, (coalesce(mean_24, c3) - c3) / s3 AS mean_24
    FROM feat f JOIN center c ON c.series_id = f.series_id JOIN scale s ON s.series_id = f.series_id AND s.fold_id = c.fold_id""",
    "traj": f"""SELECT s.series_id, s.origin, h.horizon_minutes, y.target_all AS value FROM feat s CROSS JOIN horizons h JOIN labels y ON y.series_id = s.series_id
    AND y.ts = s.origin + to_minutes(CAST(h.horizon_minutes - {STEP} AS BIGINT)) WHERE y.target_all IS NOT NULL""",
    "lib": """SELECT s.* FROM scaled s JOIN folds f ON f.fold_id = s.fold_id WHERE s.origin + INTERVAL '1380 minutes' <= f.train_end
    AND 6 = (SELECT count(*) FROM traj t WHERE t.series_id = s.series_id AND t.origin = s.origin)""",
    "dist": """SELECT q.fold_id, q.series_id, q.origin AS query_id, l.origin AS item_id, CAST(l.origin AS DATE) AS day,
    sqrt(((l.now - q.now) * (l.now - q.now) + (l.delta_6 - q.delta_6) * (l.delta_6 - q.delta_6) + (l.mean_24 - q.mean_24) * (l.mean_24 - q.mean_24)) / 3.0) AS distance
    FROM scaled q JOIN folds f ON f.fold_id = q.fold_id JOIN lib l ON l.series_id = q.series_id AND l.fold_id = q.fold_id WHERE q.origin BETWEEN f.validation_start AND f.validation_end""",
    "near": """SELECT *, row_number() OVER (PARTITION BY fold_id, series_id, query_id ORDER BY distance, item_id) AS neighbor_rank FROM (
    SELECT *, row_number() OVER (PARTITION BY fold_id, series_id, query_id, day ORDER BY distance, item_id) AS k FROM dist) WHERE k <= 2 QUALIFY neighbor_rank <= 8""",
}
ANALOG_NEEDS = ("filled", "labels", "horizons", "folds")


def analog_frame(spark, d):
    """Origins with robust-scaled state features, once per fold: its scaler sees only origins mature by its train end."""
    a, b = features.window_delta("target_all", 6)
    feats = [a, features.rolling("target_all", 24, "mean", 12)]
    rows = grid.forward_fill(base.panel(spark, d), KEYS, "ts", ["target_all"], 4, HOUR, "__now")
    rows = features.build_features(rows, KEYS, "ts", HOUR, feats).filter(on_grid("ts", STEP))
    rows = rows.select(*KEYS, F.col("ts").alias("origin"), F.col("target_all__now").alias("now"),
                       F.col("target_all__delta_6").alias("delta_6"), F.col("target_all__mean_24").alias("mean_24"))
    rows = cut(rows)
    train = splits.explode_training(rows, base.DEVELOPMENT, plus_minutes("origin", 1440 - HOUR))
    scaler = cut(fits.robust_scaler(train.drop("origin"), FOLD_KEYS, list(_FEATS)))
    each = rows.select("*", F.explode(F.array(*[F.lit(f.fold_id) for f in base.DEVELOPMENT])).alias("fold_id"))
    # A site without mature origins before a fold has no scaler there, and no rows.
    known = keyed_join(each, scaler.select(*FOLD_KEYS).distinct(), FOLD_KEYS, "left_semi")
    return cut(fits.apply_scaler(known, scaler, FOLD_KEYS, list(_FEATS)))


def analogs(spark, d):
    """Neighbours of every validation origin in its fold's own library of mature origins, and the library's futures in long form."""
    scaled = analog_frame(spark, d)
    cells = lab.supervised_long(scaled.select(*KEYS, "origin").distinct(), base.labels(spark, d), KEYS, base.HORIZONS, "target_all", STEP)
    future = lab.complete_trajectories(lab.trajectories(cells, KEYS, base.HORIZONS))
    ends = F.create_map(*[F.lit(v) for f in base.DEVELOPMENT for v in (f.fold_id, f.train_end)])
    mature = scaled.filter(plus_minutes("origin", 1440 - HOUR) <= ends[F.col("fold_id")].cast("timestamp_ntz"))
    library = cut(join_keys(mature, future, [*KEYS, "origin"]).withColumns({"v": F.array(*_FEATS), "day": F.to_date("origin")}))
    queries = scaled.filter(F.col("fold_id") == splits.validation_fold("origin", base.DEVELOPMENT)).withColumn("v", F.array(*_FEATS))
    near = nn.nearest_neighbors(queries, library, FOLD_KEYS, query="origin", item="origin", vector="v", day="day", k=8, per_day=2)
    horizon = F.array(*[F.lit(h) for h in base.HORIZONS])
    long = library.select(*FOLD_KEYS, F.col("origin").alias("item_id"), F.inline(F.arrays_zip(horizon.alias("horizon_minutes"),
                          F.col("trajectory").alias("value")))).toDF(*FOLD_KEYS, "item_id", "horizon_minutes", "value")
    return near, long


@query("m7_analog_forecast", "fold_id:s, series_id:s, query_id:t, horizon_minutes:i, prediction:d",
       sql("""SELECT n.fold_id, n.series_id, n.query_id, t.horizon_minutes, sum(t.value / greatest(n.distance, 1e-6)) / sum(1.0 / greatest(n.distance, 1e-6)) AS prediction
FROM near n JOIN traj t ON t.series_id = n.series_id AND t.origin = n.item_id GROUP BY 1, 2, 3, 4""", *ANALOG_NEEDS, **ANALOG_SQL))
def analog_forecast(spark, d):
    near, future = analogs(spark, d)
    return nn.blend_neighbors(near, future, FOLD_KEYS, 1e-6)


@query("t4_neighbor_diagnostics", "fold_id:s, series_id:s, query_id:t, nearest_distance:d, mean_neighbor_distance:d, maximum_neighbor_distance:d, effective_neighbor_count:d, unique_source_days:i",
       sql("""SELECT fold_id, series_id, query_id, min(distance) AS nearest_distance, avg(distance) AS mean_neighbor_distance, max(distance) AS maximum_neighbor_distance,
  sum(1.0 / greatest(distance, 1e-6)) * sum(1.0 / greatest(distance, 1e-6)) / sum(1.0 / (greatest(distance, 1e-6) * greatest(distance, 1e-6))) AS effective_neighbor_count,
  count(DISTINCT day) AS unique_source_days FROM near GROUP BY 1, 2, 3""", *ANALOG_NEEDS, **ANALOG_SQL))
def neighbor_facts(spark, d):
    near, _ = analogs(spark, d)
    return nn.neighbor_diagnostics(near, FOLD_KEYS, 1e-6)


@query("a29_robust_scaler", "fold_id:s, series_id:s, origin:t, now:d, delta_6:d, mean_24:d",
       sql("SELECT * FROM scaled", *ANALOG_NEEDS, **{k: ANALOG_SQL[k] for k in ("feat", "train", "center", "scale", "scaled")}))
def scaled_features(spark, d):
    return analog_frame(spark, d)


@query("h14_future_trajectories", "series_id:s, origin:t, steps:i, first_value:d, last_value:d, missing:i",
       sql(f"""SELECT o.series_id, o.origin, count(*) AS steps, max(CASE WHEN h.horizon_minutes = 240 THEN y.target_all END) AS first_value,
  max(CASE WHEN h.horizon_minutes = 1440 THEN y.target_all END) AS last_value, count(*) - count(y.target_all) AS missing
FROM origins o CROSS JOIN horizons h LEFT JOIN labels y ON y.series_id = o.series_id AND y.ts = o.origin + to_minutes(CAST(h.horizon_minutes - {STEP} AS BIGINT)) GROUP BY 1, 2""",
           "origins", "horizons", "labels"))
def future_paths(spark, d):
    o = base.origins(spark, d).select(*KEYS, "origin")
    cells = lab.supervised_long(o, base.labels(spark, d), KEYS, base.HORIZONS, "target_all", STEP, how="left")
    t = lab.trajectories(cells, KEYS, base.HORIZONS)
    return t.select(*KEYS, "origin", F.size("trajectory").alias("steps"), F.element_at("trajectory", 1).alias("first_value"),
                    F.element_at("trajectory", -1).alias("last_value"),
                    F.size(F.filter("trajectory", lambda v: v.isNull())).alias("missing"))


PROFILE_SQL = {
    "hist": "SELECT f.fold_id, l.series_id, l.ts, l.target_all AS v, extract('isodow' FROM ts) - 1 AS dow, extract('hour' FROM ts) // 4 AS slot FROM labels l JOIN folds f ON f.role = 'development' WHERE l.target_all IS NOT NULL AND ts + INTERVAL '180 minutes' <= f.train_end",
    "prof": """SELECT fold_id, series_id, 'dow_slot' AS level, dow, slot, quantile_cont(v, 0.5) AS median FROM hist GROUP BY ALL UNION ALL
    SELECT fold_id, series_id, 'slot', -1, slot, quantile_cont(v, 0.5) FROM hist GROUP BY ALL UNION ALL SELECT fold_id, series_id, 'overall', -1, -1, quantile_cont(v, 0.5) FROM hist GROUP BY ALL""",
}


def slot(ts):
    return F.floor(F.hour(ts) / 4).cast("int")


def profile_table(spark, d):
    """Medians of every fold's own history: labels complete by its train end."""
    y = splits.explode_training(base.labels(spark, d), base.DEVELOPMENT, plus_minutes("ts", STEP - HOUR))
    return fits.fit_profile(y, FOLD_KEYS, "ts", "target_all", slot("ts"))


@query("a13_calendar_profile", "fold_id:s, series_id:s, level:s, dow:i, slot:i, median:d", sql("SELECT * FROM prof", "labels", "folds", **PROFILE_SQL))
def calendar_profile(spark, d):
    return profile_table(spark, d)


@query("j15_profile_lookup", "fold_id:s, series_id:s, origin:t, horizon_minutes:i, prediction:d",
       sql("""SELECT c.fold_id, c.series_id, c.origin, c.horizon_minutes, coalesce(a.median, b.median, o.median) AS prediction FROM cells c
LEFT JOIN prof a ON a.level = 'dow_slot' AND a.fold_id = c.fold_id AND a.series_id = c.series_id AND a.dow = extract('isodow' FROM c.interval_start) - 1 AND a.slot = extract('hour' FROM c.interval_start) // 4
LEFT JOIN prof b ON b.level = 'slot' AND b.fold_id = c.fold_id AND b.series_id = c.series_id AND b.slot = extract('hour' FROM c.interval_start) // 4
LEFT JOIN prof o ON o.level = 'overall' AND o.fold_id = c.fold_id AND o.series_id = c.series_id WHERE c.target = 'target_all'""", "cells", **PROFILE_SQL))
def profile_lookup(spark, d):
    c = base.cells(spark, d, ("target_all",))
    return fits.lookup_profile(c, profile_table(spark, d), FOLD_KEYS, "interval_start", slot("interval_start"), "prediction")


@query("j16_fine_origin_expansion", "series_id:s, ts:t, fine_horizon:i, horizon_minutes:i, prediction:d",
       sql("""SELECT p.series_id, p.ts, x.fine_horizon, f.horizon_minutes, f.prediction FROM panel p CROSS JOIN (SELECT unnest([60, 240, 720, 1440]) AS fine_horizon) x
JOIN forecasts f ON f.model = 'persistence' AND f.target = 'target_all' AND f.series_id = p.series_id AND f.origin = time_bucket(INTERVAL '240 minutes', p.ts, TIMESTAMP '1970-01-01')
  AND f.horizon_minutes = least(floor(((epoch(p.ts) - epoch(f.origin)) / 60 + x.fine_horizon) / 240 + 0.5), 6) * 240""", "panel", "forecasts"))
def fine_origins(spark, d):
    coarse = base.forecasts(spark, d, ("target_all",)).filter("model = 'persistence'").select(*KEYS, "origin", "horizon_minutes", "prediction")
    return intervals.expand_to_fine(base.panel(spark, d), coarse, KEYS, "ts", STEP, (60, 240, 720, 1440)).filter("horizon_minutes > 0")


@query("j17_tariff_lookup", "series_id:s, origin:t, horizon_minutes:i, month:i, half_hour:i, price:d",
       sql("""SELECT c.series_id, c.origin, c.horizon_minutes, extract('month' FROM c.interval_start) AS month, extract('hour' FROM c.interval_start) * 2 + extract('minute' FROM c.interval_start) // 30 AS half_hour, t.price
FROM (SELECT DISTINCT series_id, origin, horizon_minutes, interval_start FROM cells) c LEFT JOIN tariff t ON t.month = extract('month' FROM c.interval_start)
  AND t.half_hour = extract('hour' FROM c.interval_start) * 2 + extract('minute' FROM c.interval_start) // 30""", "cells",
           tariff="SELECT extract('month' FROM ts) AS month, extract('hour' FROM ts) * 2 + extract('minute' FROM ts) // 30 AS half_hour, avg(value) AS price FROM events GROUP BY 1, 2"))
def tariff(spark, d):
    """A 48 x 12 price sheet (mean event value), unpivoted and looked up by target time."""
    e = readers.table(spark, d, "events", ["ts", "value"])
    months = [f"month_{m}" for m in range(1, 13)]
    sheet = e.groupBy((F.hour("ts") * 2 + F.floor(F.minute("ts") / 30)).cast("int").alias("half_hour")).agg(
        *[F.avg(F.when(F.month("ts") == i + 1, F.col("value"))).alias(m) for i, m in enumerate(months)])
    long = reshape.tariff_long(sheet, "half_hour", months)
    cells = base.cells(spark, d).select(*KEYS, "origin", "horizon_minutes", "interval_start").distinct()
    return reshape.lookup_tariff(cells, long, "interval_start")


@query("j18_target_time_covariates", "series_id:s, ts:t, horizon_minutes:i, view_at_target:d",
       sql("""SELECT a.series_id, a.ts, h.horizon_minutes, b.view AS view_at_target FROM panel a CROSS JOIN horizons h
JOIN panel b ON b.series_id = a.series_id AND b.ts = a.ts + to_minutes(CAST(h.horizon_minutes AS BIGINT))""", "panel", "horizons"))
def target_covariates(spark, d):
    """Covariates at the target time: an upper-bound diagnostic that the registry check refuses."""
    p = base.panel(spark, d)
    x = hz.expand_horizons(p.select(*KEYS, "ts"), base.HORIZONS).withColumn("target_ts", plus_minutes("ts", F.col("horizon_minutes")))
    return x.join(p.select(*KEYS, F.col("ts").alias("target_ts"), F.col("view").alias("view_at_target")), [*KEYS, "target_ts"])


@query("j19_partition_boundary_overlap", "overlap_rows:i, identical_rows:i",
       """SELECT count(*) AS overlap_rows, count(CASE WHEN a.o_custkey = b.o_custkey AND a.o_totalprice = b.o_totalprice AND a.o_orderdate = b.o_orderdate AND a.o_orderstatus = b.o_orderstatus THEN 1 END) AS identical_rows
FROM (SELECT * FROM orders WHERE o_orderdate <= TIMESTAMP '1999-06-01') a JOIN (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1999-06-01') b ON a.o_orderkey = b.o_orderkey""")
def partition_overlap(spark, d):
    o = readers.table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus"])
    cut = F.lit("1999-06-01").cast("timestamp_ntz")
    return compare.boundary_overlap(o.filter(F.col("o_orderdate") <= cut), o.filter(F.col("o_orderdate") >= cut), ["o_orderkey"])


_short = [f"target_all_t+{h}_pred" for h in (240, 480)]


def _wide_of(spark, d, model, hs):
    f = base.forecasts(spark, d, ("target_all",)).filter(F.col("model") == model)
    return reshape.to_wide(f, [*KEYS, "origin"], ["target_all"], hs)


@query("j20_table_diff", "column_name:s, shared_cells:i, only_left:i, only_right:i, changed_cells:i, mean_abs_change:d, max_abs_change:d",
       sql("""SELECT 'target_all_t+' || h || '_pred' AS column_name, count(*) AS shared_cells, 0 AS only_left, 0 AS only_right,
  count(CASE WHEN (a IS NULL) <> (b IS NULL) OR abs(a - b) > 0.001 THEN 1 END) AS changed_cells, avg(abs(b - a)) AS mean_abs_change, max(abs(b - a)) AS max_abs_change
FROM (SELECT o.series_id, o.origin, CAST(x.horizon_minutes AS VARCHAR) AS h, max(CASE WHEN f.model = 'persistence' THEN f.prediction END) AS a, max(CASE WHEN f.model = 'seasonal' THEN f.prediction END) AS b
  FROM (SELECT DISTINCT series_id, origin FROM forecasts WHERE target = 'target_all') o CROSS JOIN horizons x LEFT JOIN forecasts f ON f.target = 'target_all' AND f.series_id = o.series_id
    AND f.origin = o.origin AND f.horizon_minutes = x.horizon_minutes GROUP BY 1, 2, 3) GROUP BY 1""", "forecasts", "horizons"))
def diff(spark, d):
    a, b = (_wide_of(spark, d, m, base.HORIZONS) for m in ("persistence", "seasonal"))
    return compare.table_diff(a, b, [*KEYS, "origin"], reshape.result_columns(["target_all"], base.HORIZONS), 0.001)


@query("j20_short_is_prefix_of_long", "column_name:s, shared_cells:i, changed_cells:i",
       sql("""SELECT 'target_all_t+' || x.horizon_minutes || '_pred' AS column_name, count(*) AS shared_cells, 0 AS changed_cells
FROM (SELECT DISTINCT series_id, origin FROM forecasts WHERE target = 'target_all' AND horizon_minutes <= 480) o CROSS JOIN (SELECT unnest([240, 480]) AS horizon_minutes) x GROUP BY 1""", "forecasts"))
def prefix(spark, d):
    long = _wide_of(spark, d, "persistence", base.HORIZONS).select(*KEYS, "origin", *[F.col(f"`{c}`") for c in _short])
    short = reshape.to_wide(base.forecasts(spark, d, ("target_all",)).filter("model = 'persistence' AND period = 'short'"),
                            [*KEYS, "origin"], ["target_all"], (240, 480))
    return compare.table_diff(short, long.join(short.select(*KEYS, "origin"), [*KEYS, "origin"], "left_semi"), [*KEYS, "origin"], _short)


RESIDUAL_SQL = """SELECT t.fold_id, t.series_id, t.origin, t.horizon_minutes, t.model, t.prediction AS total, p.prediction AS part, t.prediction - p.prediction AS residual,
  greatest(0.0, least(t.prediction - p.prediction, 400.0, t.prediction)) AS other_part, t.actual AS total_actual, p.actual AS part_actual
FROM forecasts t LEFT JOIN forecasts p ON p.target = 'target_part' AND p.model = t.model AND p.fold_id = t.fold_id AND p.series_id = t.series_id AND p.origin = t.origin AND p.horizon_minutes = t.horizon_minutes
WHERE t.target = 'target_all'"""


def residual_cells(spark, d):
    f = base.forecasts(spark, d)
    on = ["fold_id", *KEYS, "origin", "horizon_minutes", "model"]
    part = f.filter("target = 'target_part'").select(*on, F.col("prediction").alias("part"), F.col("actual").alias("part_actual"))
    total = f.filter("target = 'target_all'").select(*on, F.col("prediction").alias("total"), F.col("actual").alias("total_actual"))
    return total.join(part, on, "left").withColumn("residual", F.col("total") - F.col("part"))


@query("j21_component_residual", "fold_id:s, series_id:s, origin:t, horizon_minutes:i, model:s, total:d, part:d, residual:d",
       sql(RESIDUAL_SQL, "forecasts"))
def component_residual(spark, d):
    return residual_cells(spark, d)


@query("t1_model_ranking", "target:s, model:s, rank:i, mape:d, valid_count:i",
       sql(f"SELECT target, model, row_number() OVER (PARTITION BY target ORDER BY mape, model) AS rank, mape, valid_count FROM (SELECT target, model, {base.STRICT} FROM forecasts GROUP BY 1, 2)", "forecasts"))
def ranking(spark, d):
    from pyspark.sql import Window
    ranked = metrics.rank_models(base.forecasts(spark, d), ("target", "model"))
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("target").orderBy("mape", "model")))


@query("t2_most_shifted_columns", "column_name:s, standardized_mean_shift:d",
       sql("""SELECT column_name, (test_mean - train_mean) / train_std AS standardized_mean_shift FROM (
  SELECT column_name, avg(CASE WHEN side = 'a' THEN v END) AS train_mean, avg(CASE WHEN side = 'b' THEN v END) AS test_mean, stddev_samp(CASE WHEN side = 'a' THEN v END) AS train_std FROM u GROUP BY 1)
ORDER BY abs((test_mean - train_mean) / train_std) DESC, column_name LIMIT 3""", "panel",
           u=" UNION ALL ".join(f"SELECT '{k}' AS column_name, CASE WHEN ts <= TIMESTAMP '2024-01-20 23:00:00' THEN 'a' ELSE 'b' END AS side, \"{k}\" AS v FROM panel" for k in base.KINDS)))
def most_shifted(spark, d):
    p = base.panel(spark, d)
    cut = F.lit("2024-01-20 23:00:00").cast("timestamp_ntz")
    s = profile.mean_shift(p.filter(F.col("ts") <= cut), p.filter(F.col("ts") > cut), list(base.KINDS), 1)
    return s.orderBy(F.abs("standardized_mean_shift").desc(), "column_name").limit(3)


@query("t5_top_similarity_quartile", "series_id:s, origin:t, probability:d, top_quartile:i",
       sql("""SELECT h.series_id, h.origin, h.probability, CASE WHEN h.probability >= q.cut THEN 1 ELSE 0 END AS top_quartile FROM hazard h
JOIN (SELECT series_id, quantile_cont(probability, 0.75) AS cut FROM hazard GROUP BY 1) q ON q.series_id = h.series_id""", "hazard"))
def top_quartile(spark, d):
    return metrics.top_share_flag(ev.hazard(spark, d), KEYS, "probability", 0.25, "top_quartile")


@query("u1_contiguous_history", "series_id:s, ts:t, total__mean_24:d",
       sql("""SELECT series_id, ts, m AS total__mean_24 FROM (SELECT series_id, ts, CASE WHEN count(total) OVER w >= 1 THEN avg(total) OVER w END AS m FROM users
  WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)) WHERE ts > TIMESTAMP '2024-01-24 23:00:00'""", "users"))
def history(spark, d):
    """Test rows whose windows reach back into the train partition."""
    u = base.users(spark, d).drop("inserted")
    cut = F.lit("2024-01-24 23:00:00").cast("timestamp_ntz")
    both = grid.contiguous_union(u.filter(F.col("ts") <= cut), u.filter(F.col("ts") > cut), KEYS, "ts", HOUR)
    built = features.build_features(both, KEYS, "ts", HOUR, [features.rolling("total", 24, "mean", 1)], rows=u.count())
    return built.filter("partition = 'test'")


@query("u2_key_sets", "measure:s, keys:i",
       sql("""SELECT 'union' AS measure, count(*) AS keys FROM (SELECT ts FROM od UNION SELECT ts FROM ld) UNION ALL SELECT 'intersect', count(*) FROM (SELECT ts FROM od INTERSECT SELECT ts FROM ld)
UNION ALL SELECT 'left_only', count(*) FROM (SELECT ts FROM od EXCEPT SELECT ts FROM ld) UNION ALL SELECT 'right_only', count(*) FROM (SELECT ts FROM ld EXCEPT SELECT ts FROM od)""", **DAYS))
def key_sets(spark, d):
    return compare.key_sets(order_days(spark, d), line_days(spark, d), ["ts"])


@query("u3_fold_disjointness", "fold_id:s, other_fold:s, shared_origins:i",
       sql("""SELECT a.fold_id, b.fold_id AS other_fold, count(o.origin) AS shared_origins FROM folds a JOIN folds b ON a.fold_order < b.fold_order
LEFT JOIN (SELECT DISTINCT origin FROM origins) o ON o.origin BETWEEN a.validation_start AND a.validation_end AND o.origin BETWEEN b.validation_start AND b.validation_end GROUP BY 1, 2""", "folds", "origins"))
def disjoint(spark, d):
    """Origins of the panel that two folds would both validate on; one conditional aggregate, no pairing."""
    from tidegrid.operators.splits import Fold  # noqa: F401
    moment = lambda s: F.lit(s).cast("timestamp_ntz")
    inside = lambda f: F.col("origin").between(moment(f.validation_start), moment(f.validation_end))
    items = [F.struct(F.lit(a.fold_id).alias("fold_id"), F.lit(b.fold_id).alias("other_fold"),
                      F.count_if(inside(a) & inside(b)).alias("shared_origins"))
             for i, a in enumerate(base.FOLDS) for b in base.FOLDS[i + 1:]]
    return base.origins(spark, d).select("origin").distinct().agg(F.array(*items).alias("_a")).select(F.inline("_a"))
