"""Forecast arithmetic and backtest layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.functions import blend
from tidegrid.functions.timeline import epoch_minutes, on_stride, plus_minutes
from tidegrid.operators import fits, labels as lab, metrics, splits
from tidegrid.operators.sizing import lookup_join
from tidegrid.plans import base, events_base as ev, joins
from tidegrid.plans.base import HOUR, KEYS, STEP, sql
from tidegrid.plans.joins import PAIRS_SQL, PROFILE_SQL, RESIDUAL_SQL
from tidegrid.plans.registry import query
from tidegrid.plans.scores import _scale_sql
from tidegrid.session import cut
from tidegrid.sources import readers, reshape

P = {"p": PAIRS_SQL}
CELL_SPEC = "fold_id:s, series_id:s, origin:t, target:s, horizon_minutes:i"
WIDE_SQL = """SELECT model, fold_id, series_id, origin, horizon_minutes, max(CASE WHEN target = 'target_part' THEN prediction END) AS part,
  max(CASE WHEN target = 'target_all' THEN prediction END) AS total FROM forecasts GROUP BY 1, 2, 3, 4, 5"""


def both_targets(spark, d):
    f = base.forecasts(spark, d)
    pick = lambda t: F.max(F.when(F.col("target") == t, F.col("prediction")))
    return f.groupBy("model", "fold_id", *KEYS, "origin", "horizon_minutes").agg(
        pick("target_part").alias("part"), pick("target_all").alias("total"))


@query("h1_physical_projection", "model:s, fold_id:s, series_id:s, origin:t, horizon_minutes:i, part:d, total:d, raised_total:d",
       sql("""SELECT model, fold_id, series_id, origin, horizon_minutes, CASE WHEN p IS NOT NULL AND t IS NOT NULL THEN least(p, t) ELSE p END AS part, t AS total,
  CASE WHEN p IS NOT NULL AND t IS NOT NULL THEN greatest(p, t) ELSE t END AS raised_total FROM (
  SELECT *, CASE WHEN part IS NOT NULL THEN least(greatest(part, 0.0), 40.0) END AS p, CASE WHEN total IS NOT NULL THEN least(greatest(total - 120.0, 0.0), 60.0) END AS t FROM w)""", "forecasts", w=WIDE_SQL))
def projection(spark, d):
    """Totals shifted down so that all three repairs really happen."""
    w = both_targets(spark, d)
    total = F.col("total") - 120.0
    low = blend.project_bounds(F.col("part"), total, 40.0, 60.0)
    high = blend.project_bounds(F.col("part"), total, 40.0, 60.0, repair="raise_total")
    return w.select("model", "fold_id", *KEYS, "origin", "horizon_minutes", low["part"].alias("part"), low["total"].alias("total"),
                    high["total"].alias("raised_total"))


@query("h2_residual_part", "fold_id:s, series_id:s, origin:t, horizon_minutes:i, model:s, other_part:d",
       sql("SELECT fold_id, series_id, origin, horizon_minutes, model, other_part FROM r WHERE part IS NOT NULL AND total IS NOT NULL", "forecasts", r=RESIDUAL_SQL))
def residual_part(spark, d):
    r = joins.residual_cells(spark, d).filter("part IS NOT NULL AND total IS NOT NULL")
    return r.withColumn("other_part", blend.residual_part(F.col("total"), F.col("part"), 400.0))


@query("h3_symmetric_cap", f"{CELL_SPEC}, capped:d",
       sql("SELECT *, control + CASE WHEN candidate IS NOT NULL THEN greatest(-15.0, least(15.0, 0.5 * (candidate - control))) END AS capped FROM p", "forecasts", **P))
def capped(spark, d):
    return joins.pairs(spark, d).withColumn("capped", blend.symmetric_cap(F.col("control"), F.col("candidate"), 15.0, 0.5))


TREND_SQL = """SELECT c.fold_id, c.series_id, c.origin, c.target, c.horizon_minutes, c.actual, c.now AS control,
  (0.4 * (x.view - x.view_lag) + 0.25 * (x.click - x.click_lag)) * least(c.horizon_minutes / 480.0, 1.5) AS raw FROM cells c
JOIN (SELECT series_id, ts, view, click, lag(view, 4) OVER w AS view_lag, lag(click, 4) OVER w AS click_lag FROM panel WINDOW w AS (PARTITION BY series_id ORDER BY ts)) x ON x.series_id = c.series_id AND x.ts = c.origin"""


def trend_cells(spark, d):
    from tidegrid.operators import features
    moves = features.build_features(base.panel(spark, d), KEYS, "ts", HOUR, [features.difference("view", 4), features.difference("click", 4)])
    moves = moves.select(*KEYS, F.col("ts").alias("origin"), "view__diff_4", "click__diff_4")
    x = base.cells(spark, d).join(moves, [*KEYS, "origin"]).withColumnRenamed("now", "control")
    parts = blend.damped_trend({"view__diff_4": 0.4, "click__diff_4": 0.25}, F.col("horizon_minutes"), 480.0, 1.5, 12.0)
    return x.withColumns({"raw": parts["raw"], "applied": parts["applied"]})


@query("h4_damped_trend", f"{CELL_SPEC}, raw:d, applied:d",
       sql("SELECT *, CASE WHEN raw IS NOT NULL THEN greatest(-12.0, least(12.0, raw)) END AS applied FROM t", "cells", t=TREND_SQL))
def damped(spark, d):
    return trend_cells(spark, d)


@query("h16_trend_correction", f"{CELL_SPEC}, control:d, raw_correction:d, applied_correction:d, candidate:d",
       sql("""SELECT *, raw AS raw_correction, coalesce(CASE WHEN raw IS NOT NULL THEN greatest(-12.0, least(12.0, raw)) END, 0.0) AS applied_correction,
  greatest(0.0, control + coalesce(greatest(-12.0, least(12.0, raw)), 0.0)) AS candidate FROM t WHERE control IS NOT NULL AND raw IS NOT NULL
UNION ALL SELECT *, raw, 0.0, greatest(0.0, control) FROM t WHERE control IS NOT NULL AND raw IS NULL""", "cells", t=TREND_SQL))
def corrected(spark, d):
    t = trend_cells(spark, d).filter("control IS NOT NULL")
    applied = F.coalesce("applied", F.lit(0.0))
    return t.withColumns({"raw_correction": F.col("raw"), "applied_correction": applied,
                          "candidate": F.greatest(F.lit(0.0), F.col("control") + applied)})


@query("h5_convex_blend", f"{CELL_SPEC}, blended:d",
       sql("""SELECT *, CASE WHEN target = 'target_part' THEN (x // 10000 + CASE WHEN x % 10000 > 5000 OR (x % 10000 = 5000 AND (x // 10000) % 2 = 1) THEN 1 ELSE 0 END) / 1000.0 ELSE control END AS blended
FROM (SELECT *, CAST(round((0.75 * control + 0.25 * candidate) * 10000000) AS BIGINT) AS x FROM p WHERE candidate IS NOT NULL AND control IS NOT NULL)""", "forecasts", **P))
def convex(spark, d):
    p = joins.pairs(spark, d).filter("candidate IS NOT NULL AND control IS NOT NULL")
    mixed = blend.convex(F.col("control"), F.col("candidate"), 0.25, 3)
    return p.withColumn("blended", F.when(F.col("target") == "target_part", mixed).otherwise(F.col("control")))


_PAST_SQL = "SELECT f.fold_id, p.series_id, extract('isodow' FROM p.ts) AS dow, extract('hour' FROM p.ts) AS hr, p.target_all FROM panel p JOIN folds f ON f.role = 'development' AND p.ts <= f.train_end"
MIX_SQL = f"""SELECT c.*, coalesce(k.mean, k2.mean, k3.mean) AS climate, r.ratio, c.now AS tree, c.day_before AS proxy FROM cells c
LEFT JOIN (SELECT fold_id, series_id, dow, hr, avg(target_all) AS mean FROM ({_PAST_SQL}) GROUP BY ALL) k
  ON k.fold_id = c.fold_id AND k.series_id = c.series_id AND k.dow = extract('isodow' FROM c.interval_start) AND k.hr = extract('hour' FROM c.interval_start)
LEFT JOIN (SELECT fold_id, series_id, hr, avg(target_all) AS mean FROM ({_PAST_SQL}) GROUP BY ALL) k2 ON k2.fold_id = c.fold_id AND k2.series_id = c.series_id AND k2.hr = extract('hour' FROM c.interval_start)
LEFT JOIN (SELECT fold_id, series_id, avg(target_all) AS mean FROM ({_PAST_SQL}) GROUP BY ALL) k3 ON k3.fold_id = c.fold_id AND k3.series_id = c.series_id
JOIN ratios r ON r.series_id = c.series_id AND r.ts = c.origin WHERE c.target = 'target_all'"""


def mixture_cells(spark, d):
    """Tree stand-in (last value), proxy (day before), climatology and the low-level ratio of the origin.

    The climatology is that of the fold's own training time: of the weekday and hour, else of the hour, else of all.
    """
    past = splits.explode_training(base.panel(spark, d).select(*KEYS, "ts", "target_all"), base.DEVELOPMENT, F.col("ts"))
    slot = past.groupBy("fold_id", *KEYS, F.weekday("ts").alias("dow"), F.hour("ts").alias("hr")).agg(F.sum("target_all").alias("_s"), F.count("target_all").alias("_n"))
    slot = cut(slot)
    mean = F.sum("_s") / F.nullif(F.sum("_n"), F.lit(0))
    by_slot = slot.select("fold_id", *KEYS, "dow", "hr", (F.col("_s") / F.nullif(F.col("_n"), F.lit(0))).alias("_slot"))
    by_hour = slot.groupBy("fold_id", *KEYS, "hr").agg(mean.alias("_hour"))
    overall = slot.groupBy("fold_id", *KEYS).agg(mean.alias("_all"))
    ratio = ev.ratios(spark, d).select(*KEYS, F.col("ts").alias("origin"), "ratio")
    c = base.cells(spark, d, ("target_all",)).withColumns({"dow": F.weekday("interval_start"), "hr": F.hour("interval_start")})
    c = c.join(by_slot, ["fold_id", *KEYS, "dow", "hr"], "left").join(by_hour, ["fold_id", *KEYS, "hr"], "left").join(overall, ["fold_id", *KEYS], "left")
    c = c.withColumn("climate", F.coalesce("_slot", "_hour", "_all")).drop("_slot", "_hour", "_all")
    return c.join(ratio, [*KEYS, "origin"]).withColumnsRenamed({"now": "tree", "day_before": "proxy"})


@query("h7_gated_mixture", f"{CELL_SPEC}, mixed:d",
       sql("""SELECT *, CASE WHEN abs(ratio - 1.0) > 0.2 THEN m * least(greatest(ratio, 0.7), 1.3) ELSE m END AS mixed FROM (
  SELECT *, CASE WHEN horizon_minutes // 240 <= 3 THEN 0.6 * tree + 0.3 * proxy + 0.1 * climate ELSE 0.3 * tree + 0.3 * proxy + 0.4 * climate END AS m FROM x)""", "cells", "ratios", "folds", x=MIX_SQL))
def mixture(spark, d):
    x = mixture_cells(spark, d)
    parts = {"tree": (F.col("tree"), 0.6, 0.3), "proxy": (F.col("proxy"), 0.3, 0.3), "climate": (F.col("climate"), 0.1, 0.4)}
    return x.withColumn("mixed", blend.gated_mixture((F.col("horizon_minutes") / STEP).cast("int"), parts, 3, F.col("ratio"), 0.2, 0.7, 1.3))


@query("h8_ladder_blend_and_inverse", f"{CELL_SPEC}, weight:d, blended:d, recovered:d",
       sql("""SELECT *, (blended - weight * candidate) / (1 - weight) AS recovered FROM (SELECT *, (1 - weight) * control + weight * candidate AS blended FROM (
  SELECT *, CASE WHEN horizon_minutes <= 480 THEN 0.2 ELSE 0.5 END AS weight FROM p))""", "forecasts", **P))
def ladder(spark, d):
    p = joins.pairs(spark, d).withColumn("weight", blend.ladder_weight(F.col("horizon_minutes"), 480, 0.2, 0.5))
    p = p.withColumn("blended", blend.convex(F.col("control"), F.col("candidate"), F.col("weight")))
    return p.withColumn("recovered", blend.uninvert_blend(F.col("blended"), F.col("candidate"), F.col("weight")))


@query("h9_masked_scale", f"{CELL_SPEC}, scaled:d",
       sql("""SELECT *, CASE WHEN target = 'target_all' AND interval_start BETWEEN TIMESTAMP '2024-01-22 12:00:00' AND TIMESTAMP '2024-01-23 08:00:00' THEN control * 0.9 ELSE control END AS scaled FROM p""", "forecasts", **P))
def masked(spark, d):
    moment = lambda s: F.lit(s).cast("timestamp_ntz")
    mask = (F.col("target") == "target_all") & F.col("interval_start").between(moment("2024-01-22 12:00:00"), moment("2024-01-23 08:00:00"))
    return joins.pairs(spark, d).withColumn("scaled", blend.masked_scale(F.col("control"), mask, 0.9))


@query("h10_sample_weights", "series_id:s, ts:t, mape_weight:d, low_state_weight:d, odds_weight:d",
       sql("""SELECT series_id, ts, w1 / avg(w1) OVER g AS mape_weight, w2 AS low_state_weight, w3 / avg(w3) OVER g AS odds_weight FROM (
  SELECT series_id, ts, 1.0 / greatest(abs(target_all), 25.0) AS w1, CASE WHEN ratio < 0.8 THEN 3.0 ELSE 1.0 END AS w2, least(greatest(q / (1 - q), 0.2), 5.0) AS w3
  FROM (SELECT *, least(greatest(1.0 / (1.0 + exp((ratio - 0.75) * 4.0)), 1e-6), 1 - 1e-6) AS q FROM ratios WHERE ratio IS NOT NULL AND target_all IS NOT NULL)) WINDOW g AS (PARTITION BY series_id)""", "ratios"))
def weights(spark, d):
    x = ev.ratios(spark, d).filter("ratio IS NOT NULL AND target_all IS NOT NULL")
    p = F.lit(1.0) / (F.lit(1.0) + F.exp((F.col("ratio") - 0.75) * 4.0))
    x = x.select(*KEYS, "ts", blend.inverse_target_weight(F.col("target_all"), 25.0).alias("w1"),
                 blend.low_state_weight(F.col("ratio"), 0.8, 3.0).alias("low_state_weight"), blend.odds_weight(p, 0.2, 5.0).alias("w3"))
    return blend.mean_one(blend.mean_one(x, "w1", KEYS, "mape_weight"), "w3", KEYS, "odds_weight")


@query("h11_wide_long_round_trip", "series_id:s, origin:t, target:s, horizon_minutes:i, prediction:d",
       sql("""SELECT o.series_id, o.origin, t.target, h.horizon_minutes, f.prediction FROM (SELECT DISTINCT series_id, origin FROM forecasts WHERE model = 'persistence') o CROSS JOIN (SELECT unnest(['target_part', 'target_all']) AS target) t
CROSS JOIN horizons h LEFT JOIN forecasts f ON f.model = 'persistence' AND f.series_id = o.series_id AND f.origin = o.origin AND f.target = t.target AND f.horizon_minutes = h.horizon_minutes""", "forecasts", "horizons"))
def round_trip(spark, d):
    f = base.forecasts(spark, d).filter("model = 'persistence'")
    wide = reshape.to_wide(f, [*KEYS, "origin"], base.TARGETS, base.HORIZONS)
    return reshape.to_long(wide, [*KEYS, "origin"], reshape.result_columns(base.TARGETS, base.HORIZONS))


@query("h12_family_from_file_name", "family:s, files:i, bytes:i")
def families(spark, d):
    files = readers.file_fingerprints(spark, f"{d}/*.parquet")
    return files.groupBy(readers.family_key(F.col("file_name")).alias("family")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


@query("h15_swap_component", f"{CELL_SPEC}, swapped:d",
       sql("SELECT *, greatest(0.0, tree + CASE WHEN horizon_minutes <= 480 THEN 0.2 ELSE 0.4 END * (climate - proxy)) AS swapped FROM x WHERE tree IS NOT NULL AND proxy IS NOT NULL", "cells", "ratios", "folds", x=MIX_SQL))
def swap(spark, d):
    x = mixture_cells(spark, d).filter("tree IS NOT NULL AND proxy IS NOT NULL")
    w = blend.ladder_weight(F.col("horizon_minutes"), 480, 0.2, 0.4)
    return x.withColumn("swapped", blend.swap_component(F.col("tree"), F.col("proxy"), F.col("climate"), w))


# --- Layout ----------------------------------------------------------------------------------

ASSIGN_SQL = """SELECT fold_id, fold_order, role, train_end, origin, origin + INTERVAL '180 minutes' AS short_label_end, origin + INTERVAL '1380 minutes' AS long_label_end,
  time_bucket(INTERVAL '240 minutes', train_end - INTERVAL '1380 minutes', TIMESTAMP '1970-01-01') AS latest_train_origin
FROM (SELECT *, unnest(generate_series(validation_start, validation_end, INTERVAL '240 minutes')) AS origin FROM folds)"""


def observed_assignments(spark, d, folds=base.FOLDS):
    """Fold layout joined to the origins each series really has."""
    table = splits.assignments(splits.fold_table(spark, folds), STEP, base.HORIZONS, HOUR)
    return base.origins(spark, d).select(*KEYS, "origin").join(table, "origin")


@query("b1_rolling_origin_assignment", "series_id:s, fold_id:s, role:s, origin:t, train_end:t, short_label_end:t, long_label_end:t",
       sql("SELECT o.series_id, a.* FROM a JOIN origins o ON o.origin = a.origin", "origins", "folds", a=ASSIGN_SQL))
def assignment(spark, d):
    return observed_assignments(spark, d)


@query("b2_walk_forward_with_checks", "fold_id:s, role:s, origins:i, first_origin:t, last_origin:t, latest_train_origin:t, problems:i",
       sql("""SELECT a.fold_id, a.role, count(*) AS origins, min(a.origin) AS first_origin, max(a.origin) AS last_origin, max(a.latest_train_origin) AS latest_train_origin,
  count(CASE WHEN a.origin <= a.train_end OR a.latest_train_origin > a.train_end THEN 1 END) AS problems FROM a JOIN origins o ON o.origin = a.origin GROUP BY 1, 2""", "origins", "folds", a=ASSIGN_SQL))
def walk_forward(spark, d):
    a = observed_assignments(spark, d)
    bad = splits.layout_problems(a, STEP).groupBy("fold_id").agg(F.count(F.lit(1)).alias("n"))
    table = a.groupBy("fold_id", "role").agg(F.count(F.lit(1)).alias("origins"), F.min("origin").alias("first_origin"),
                                             F.max("origin").alias("last_origin"), F.max("latest_train_origin").alias("latest_train_origin"))
    return table.join(bad, "fold_id", "left").withColumn("problems", F.coalesce("n", F.lit(0)))


@query("b3_block_layout", "fold_id:s, origin_count:i, shared_origins:i, reserved_origins:i, layout_ok:b, observed_origins:i",
       sql("""SELECT f.fold_id, count(DISTINCT o.origin) AS origin_count, count(DISTINCT CASE WHEN g.fold_id IS NOT NULL THEN o.origin END) AS shared_origins,
  count(DISTINCT CASE WHEN h.fold_id IS NOT NULL THEN o.origin END) AS reserved_origins,
  count(DISTINCT o.origin) = 12 AND count(DISTINCT CASE WHEN g.fold_id IS NOT NULL THEN o.origin END) = 0 AND count(DISTINCT CASE WHEN h.fold_id IS NOT NULL THEN o.origin END) = 0 AS layout_ok,
  count(DISTINCT (o.series_id, o.origin)) AS observed_origins
FROM folds f JOIN origins o ON o.origin BETWEEN f.validation_start AND f.validation_end
LEFT JOIN folds g ON g.role = 'development' AND g.fold_id <> f.fold_id AND o.origin BETWEEN g.validation_start AND g.validation_end
LEFT JOIN folds h ON h.role = 'sealed' AND o.origin BETWEEN h.validation_start AND h.validation_end WHERE f.role = 'development' GROUP BY 1""", "origins", "folds"))
def blocks(spark, d):
    dev = splits.fold_table(spark, base.DEVELOPMENT)
    sealed = splits.fold_table(spark, base.FOLDS[3:])
    seen = base.origins(spark, d).withColumn("fold_id", splits.validation_fold("origin", base.DEVELOPMENT)).filter("fold_id IS NOT NULL")
    return splits.block_layout(dev, sealed, STEP, 12).join(
        seen.groupBy("fold_id").agg(F.count(F.lit(1)).alias("observed_origins")), "fold_id")


@query("b4_event_origins", "series_id:s, episode_id:s, lead_hours:i, origin:t, split_group:s",
       sql("SELECT e.series_id, e.episode_id, l.lead_hours, e.episode_start - to_hours(CAST(l.lead_hours AS BIGINT)) AS origin, e.episode_id AS split_group FROM episodes e CROSS JOIN (SELECT unnest([1, 2, 6, 12]) AS lead_hours) l", "episodes"))
def event_origins(spark, d):
    from tidegrid.operators.intervals import event_origins as build
    return build(ev.episodes(spark, d), (1, 2, 6, 12), KEYS)


@query("b5_expanding_second_stage", "validation_fold:s, train_fold:s, train_cells:i, validation_cells:i",
       sql("""SELECT v.fold_id AS validation_fold, t.fold_id AS train_fold, (SELECT count(*) FROM forecasts f WHERE f.fold_id = t.fold_id) AS train_cells, (SELECT count(*) FROM forecasts f WHERE f.fold_id = v.fold_id) AS validation_cells
FROM folds v JOIN folds t ON t.fold_order < v.fold_order WHERE v.role = 'development' AND t.role = 'development'""", "forecasts", "folds"))
def second_stage(spark, d):
    pairs = splits.expanding_pairs(spark, base.DEVELOPMENT)
    n = base.forecasts(spark, d).groupBy("fold_id").agg(F.count(F.lit(1)).alias("n"))
    return (pairs.join(n.withColumnsRenamed({"fold_id": "train_fold", "n": "train_cells"}), "train_fold")
            .join(n.withColumnsRenamed({"fold_id": "validation_fold", "n": "validation_cells"}), "validation_fold"))


@query("b6_day_grouped_folds", "fold:i, days:i, positives:i, rows:i",
       sql(f"""SELECT fold, count(DISTINCT day) AS days, sum(low) AS positives, count(*) AS rows FROM r JOIN (
  SELECT day, (row_number() OVER (PARTITION BY c ORDER BY h) - 1) % 5 AS fold FROM (SELECT day, max(low) AS c, ('0x' || substr(md5(day || '/17'), 1, 13))::BIGINT AS h FROM r GROUP BY day)) USING (day) GROUP BY 1""", "ratios",
           r=f"SELECT *, series_id || '/' || strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, CASE WHEN ratio < {ev.THRESHOLD} THEN 1 ELSE 0 END AS low FROM ratios WHERE ratio IS NOT NULL"))
def day_folds(spark, d):
    """Days stay whole and both day classes spread evenly over the folds."""
    r = ev.ratios(spark, d).filter("ratio IS NOT NULL").withColumns({"day": F.concat_ws("/", "series_id", F.to_date("ts").cast("string")),
                                                                    "low": (F.col("ratio") < ev.THRESHOLD).cast("int")})
    x = splits.grouped_folds(r, "day", "low", 5, 17)
    return x.groupBy("fold").agg(F.count_distinct("day").alias("days"), F.sum("low").alias("positives"), F.count(F.lit(1)).alias("rows"))


@query("b7_two_block_transfer", "target:s, fit_block:s, test_block:s, scale:d, before_mape:d, after_mape:d",
       sql(f"""SELECT s.target, s.fold_id AS fit_block, f.fold_id AS test_block, s.scale, avg(CASE WHEN abs(actual) > 0 THEN abs((prediction - actual) / actual) END) AS before_mape,
  avg(CASE WHEN abs(actual) > 0 THEN abs((prediction * s.scale - actual) / actual) END) AS after_mape
FROM s JOIN b f ON f.target = s.target AND f.fold_id <> s.fold_id GROUP BY 1, 2, 3, 4""", "forecasts",
           b="SELECT * FROM forecasts WHERE model = 'persistence' AND fold_id IN ('fold_1', 'fold_2')", s=_scale_sql("b", "target, fold_id")))
def transfer(spark, d):
    f = base.forecasts(spark, d).filter("model = 'persistence' AND fold_id IN ('fold_1', 'fold_2')")
    s = metrics.optimal_scale(f, ["target", "fold_id"], "actual", "prediction", "scale").withColumnRenamed("fold_id", "fit_block")
    other = F.when(F.col("fold_id") == "fold_1", "fold_2").otherwise("fold_1")
    x = lookup_join(f.withColumn("fit_block", other), s, ["target", "fit_block"]).withColumn("scaled", F.col("prediction") * F.col("scale"))
    return x.groupBy("target", "fit_block", F.col("fold_id").alias("test_block"), "scale").agg(
        metrics.floor_mape("actual", "prediction", 0).alias("before_mape"), metrics.floor_mape("actual", "scaled", 0).alias("after_mape"))


@query("b8_horizon_cohorts", "cohort:i, model:s, cells:i, mape:d",
       sql("""SELECT (horizon_minutes // 240 - 1) // 2 AS cohort, model, count(*) AS cells, avg(CASE WHEN actual <> 0 THEN abs((prediction - actual) / actual) END) AS mape FROM forecasts GROUP BY 1, 2""", "forecasts"))
def cohorts(spark, d):
    table = splits.cohort_table(spark, base.HORIZONS, 2)
    f = base.forecasts(spark, d).join(F.broadcast(table), "horizon_minutes")   # one row per horizon
    a, p = F.col("actual"), F.col("prediction")
    return f.groupBy("cohort", "model").agg(F.count(F.lit(1)).alias("cells"), F.avg(F.when(a != 0, F.abs((p - a) / a))).alias("mape"))


@query("b9_mature_library", "fold_id:s, series_id:s, origin:t, steps:i, mean_future:d",
       sql(f"""SELECT f.fold_id, o.series_id, o.origin, count(*) AS steps, avg(y.target_all) AS mean_future FROM origins o JOIN folds f ON f.role = 'development' AND o.origin + INTERVAL '1380 minutes' <= f.train_end CROSS JOIN horizons h JOIN labels y ON y.series_id = o.series_id
  AND y.ts = o.origin + to_minutes(CAST(h.horizon_minutes - {STEP} AS BIGINT)) WHERE (epoch(o.origin) // 60) % 480 = 0
GROUP BY 1, 2, 3 HAVING count(y.target_all) = 6""", "origins", "horizons", "labels", "folds"))
def library(spark, d):
    o = base.origins(spark, d).select(*KEYS, "origin").filter(on_stride("origin", 480))
    cells = lab.supervised_long(o, base.labels(spark, d), KEYS, base.HORIZONS, "target_all", STEP, how="left")
    t = lab.complete_trajectories(lab.trajectories(cells, KEYS, base.HORIZONS))
    mean = F.aggregate("trajectory", F.lit(0.0), lambda a, v: a + v) / F.size("trajectory")
    table = t.select(*KEYS, "origin", F.size("trajectory").alias("steps"), mean.alias("mean_future"))
    return splits.explode_training(table, base.DEVELOPMENT, plus_minutes("origin", 1440 - HOUR))


@query("b10_leave_episode_out", "episode_group:i, horizon_minutes:i, validation_start:t, validation_end:t, train_end:t, train_origins:i, validation_origins:i",
       sql("""SELECT g.*, count(CASE WHEN h.origin <= g.train_end THEN 1 END) AS train_origins, count(CASE WHEN h.origin >= g.validation_start AND h.origin < g.validation_end THEN 1 END) AS validation_origins FROM (
  SELECT episode_group, horizon_minutes, validation_start, validation_end, validation_start - to_minutes(CAST(horizon_minutes AS BIGINT)) AS train_end FROM (
    SELECT episode_number % 3 AS episode_group, min(episode_start) - INTERVAL '24 hours' AS validation_start, max(episode_start) AS validation_end FROM episodes GROUP BY 1) CROSS JOIN horizons) g
CROSS JOIN hazard h GROUP BY ALL""", "episodes", "hazard", "horizons"))
def episode_out(spark, d):
    """Bounds per group and horizon, and the origins on either side of them from running sums over distinct moments."""
    e = ev.episodes(spark, d).withColumn("episode_group", (F.col("episode_number") % 3).cast("int"))
    bounds = splits.embargo_folds(e, "episode_group", base.HORIZONS)
    moments = cut(ev.hazard(spark, d).groupBy(F.col("origin").alias("ts")).agg(F.count(F.lit(1)).alias("n")))
    bounds = splits.counted_until(moments, bounds, "train_end", "train_origins", inclusive=True)
    bounds = splits.counted_until(moments, bounds, "validation_start", "_before", inclusive=False)
    bounds = splits.counted_until(moments, bounds, "validation_end", "_until", inclusive=False)
    # A group of one episode ends where another's range may begin; nothing lies between then.
    return bounds.withColumn("validation_origins", F.greatest(F.col("_until") - F.col("_before"), F.lit(0)))
