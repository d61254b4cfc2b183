"""Contract checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.operators import checks, compare, features, splits
from tidegrid.operators.grid import forward_fill
from tidegrid.plans import base, joins, windows
from tidegrid.plans.base import HOUR, KEYS, STEP, sql
from tidegrid.plans.blends import WIDE_SQL, both_targets
from tidegrid.plans.joins import DAYS
from tidegrid.plans.registry import query


@query("k1_raw_table_contract", "table_name:s, severity:s, problem:s, detail:i",
       sql("""SELECT * FROM (SELECT 'orders' AS table_name, 'error' AS severity, 'missing_columns' AS problem, 1 AS detail
UNION ALL SELECT 'lineitem', 'warning', 'extra_columns', 1
UNION ALL SELECT 'orders', 'warning', 'off_step_moments', count(CASE WHEN s <> 1440 THEN 1 END) FROM (SELECT (epoch(ts) - epoch(lag(ts) OVER (ORDER BY ts))) // 60 AS s FROM od)
UNION ALL SELECT 'lineitem', 'warning', 'off_step_moments', count(CASE WHEN s <> 1440 THEN 1 END) FROM (SELECT (epoch(ts) - epoch(lag(ts) OVER (ORDER BY ts))) // 60 AS s FROM ld)
UNION ALL SELECT 'lineitem', 'error', 'moments_not_in_first_table', count(*) FROM ld WHERE ts NOT IN (SELECT ts FROM od)) WHERE detail > 0""", **DAYS))
def raw_contract(spark, d):
    """Two daily families against a declared layout that asks for one column too many and one too few."""
    t = {"orders": joins.order_days(spark, d), "lineitem": joins.line_days(spark, d)}
    want = {"orders": ["ts", "order_total", "order_count", "order_tax"], "lineitem": ["ts", "ship_total"]}
    return checks.raw_contract(spark, t, want, [], "ts", base.DAY)


@query("k2_result_contract", "problem:s, detail:i",
       sql("""SELECT 'not_finite' AS problem, count(CASE WHEN part IS NULL OR total IS NULL THEN 1 END) AS detail FROM w UNION ALL SELECT 'negative', count(CASE WHEN part < 0 OR total < 0 THEN 1 END) FROM w
UNION ALL SELECT 'above_maximum', count(CASE WHEN part > 60 OR total > 200 THEN 1 END) FROM w UNION ALL SELECT 'part_above_total', count(CASE WHEN part > total THEN 1 END) FROM w
UNION ALL SELECT 'missing_keys', count(*) FROM e WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.series_id = e.series_id AND w.origin = e.origin AND w.horizon_minutes = e.horizon_minutes)
UNION ALL SELECT 'unexpected_keys', count(*) FROM w WHERE NOT EXISTS (SELECT 1 FROM e WHERE w.series_id = e.series_id AND w.origin = e.origin AND w.horizon_minutes = e.horizon_minutes)
UNION ALL SELECT 'duplicate_keys', count(*) FROM (SELECT 1 FROM w GROUP BY series_id, origin, horizon_minutes HAVING count(*) > 1)""", "forecasts", "origins", "horizons", "folds",
           v=WIDE_SQL, w="SELECT * FROM v WHERE model = 'persistence'",
           e="SELECT o.series_id, o.origin, h.horizon_minutes FROM origins o JOIN folds f ON f.role = 'development' AND o.origin BETWEEN f.validation_start AND f.validation_end CROSS JOIN horizons h"))
def result_contract(spark, d):
    from tidegrid.functions.horizons import expand_horizons
    o = base.origins(spark, d).withColumn("fold_id", splits.validation_fold("origin", base.DEVELOPMENT)).filter("fold_id IS NOT NULL")
    expected = expand_horizons(o.select(*KEYS, "origin"), base.HORIZONS)
    w = both_targets(spark, d).filter("model = 'persistence'")
    return checks.result_contract(w, expected, [*KEYS, "origin", "horizon_minutes"], "part", "total", part_max=60, total_max=200)


@query("k4_registry_causality", "feature_name:s, problem:s, panel_rows:i",
       sql("""SELECT * FROM (VALUES ('target_all__previous_interval', 'diagnostic'), ('view__ahead', 'reads_future'), ('view__ahead', 'not_causal'), ('click__lag_1', 'duplicate_name')) AS r(feature_name, problem)
CROSS JOIN (SELECT count(*) AS panel_rows FROM panel)""", "panel"))
def causality(spark, d):
    """A registry with one target-history feature, one that looks ahead, and one listed twice."""
    ahead = features.Feature("view__ahead", "view", "lead", 1, 1, lambda w: F.lead("view", 1).over(w))
    feats = [features.lag("click", 1), features.lag("click", 1), features.shifted_label("target_all"), ahead]
    return checks.registry_problems(features.registry(spark, feats, HOUR)).withColumn(
        "panel_rows", F.lit(base.panel(spark, d).count()))


@query("k5_future_perturbation", "operator:s, changed_rows:i",
       sql("SELECT op AS operator, 0 AS changed_rows FROM (SELECT unnest(['features', 'forward_fill', 'low_level_ratio']) AS op) WHERE (SELECT count(*) FROM panel) > 0", "panel"))
def perturbation(spark, d):
    """Every causal operator keeps its past when only the future of the inputs changes."""
    p = base.panel(spark, d).select(*KEYS, "ts", "view", "click", "target_all")
    cut = F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")
    feats = [features.lag("view", 3), features.rolling("click", 24, "mean", 5), *features.window_delta("target_all", 6),
             features.missing_fraction("click", 12), *features.mean_difference("view", 6)]
    ops = {"features": lambda x: features.build_features(x, KEYS, "ts", HOUR, feats).select(*KEYS, "ts", *[f.name for f in feats]),
           "forward_fill": lambda x: forward_fill(x, KEYS, "ts", ["view"], 4, HOUR).select(*KEYS, "ts", "view"),
           "low_level_ratio": lambda x: features.build_features(x, KEYS, "ts", HOUR, features.low_level_ratio("target_all", 4, 72, 24, "ratio")).select(*KEYS, "ts", "ratio")}
    parts = [checks.future_change(op, p, "ts", cut, ["view", "click", "target_all"]).agg(F.count(F.lit(1)).alias("changed_rows"))
             .select(F.lit(name).alias("operator"), "changed_rows") for name, op in ops.items()]
    return compare.union_forecasts(parts)


@query("k6_cell_count", "row_count:i, expected_rows:i, complete:b",
       sql("""SELECT count(*) AS row_count, count(DISTINCT series_id) * count(DISTINCT origin) * count(DISTINCT horizon_minutes) AS expected_rows,
  count(*) = count(DISTINCT series_id) * count(DISTINCT origin) * count(DISTINCT horizon_minutes) AS complete FROM wide_cells""", "wide_cells"))
def cell_count(spark, d):
    return checks.cell_count(base.wide_cells(spark, d), ["series_id", "origin", "horizon_minutes"])


@query("k7_fold_coverage", "fold_id:s, validation_cells:i, missing_labels:i, training_cells:i, negative_residuals:i",
       sql("""SELECT c.fold_id, count(*) AS validation_cells, count(*) - count(c.target_part) AS missing_labels, any_value(t.training_cells) AS training_cells,
  count(CASE WHEN c.target_all - c.target_part < 0 THEN 1 END) AS negative_residuals FROM wide_cells c
JOIN (SELECT f.fold_id, count(*) AS training_cells FROM folds f JOIN origins o ON true CROSS JOIN horizons h WHERE o.origin + to_minutes(CAST(h.horizon_minutes - 60 AS BIGINT)) <= f.train_end GROUP BY 1) t ON t.fold_id = c.fold_id GROUP BY 1""",
           "wide_cells"))
def preflight(spark, d):
    o = base.origins(spark, d).select(*KEYS, "origin", splits.validation_fold("origin", base.DEVELOPMENT).alias("fold_id"))
    y = base.labels(spark, d)
    cov = splits.coverage(o.filter("fold_id IS NOT NULL"), y, KEYS, "target_part", base.HORIZONS, STEP)
    train = splits.training_rows(base.origins(spark, d).select("origin"), base.DEVELOPMENT, base.HORIZONS, HOUR)
    neg = base.wide_cells(spark, d).groupBy("fold_id").agg(
        F.count_if(F.col("target_all") - F.col("target_part") < 0).alias("negative_residuals"))
    return cov.join(train, "fold_id").join(neg, "fold_id")
