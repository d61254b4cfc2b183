"""Labels, naive forecasts and their scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.operators import metrics
from tidegrid.plans import base
from tidegrid.plans.base import STRICT, STRICT_SPEC, sql
from tidegrid.plans.registry import query


@query("e17_naive_forecasts_scored", f"model:s, target:s, horizon_minutes:i, {STRICT_SPEC}",
       sql(f"SELECT model, target, horizon_minutes, {STRICT} FROM forecasts GROUP BY 1, 2, 3", "forecasts"))
def naive_scored(spark, d):
    return base.forecasts(spark, d).groupBy("model", "target", "horizon_minutes").agg(*metrics.strict_errors())


@query("a1_interval_means", "series_id:s, ts:t, target_part:d, target_all:d, target_part__complete:b, interval_inserted:b",
       sql("""SELECT l.series_id, l.ts, l.target_part, l.target_all, l.target_part IS NOT NULL AS target_part__complete,
  a.ts IS NULL AS interval_inserted FROM labels l LEFT JOIN interval_agg a ON a.series_id = l.series_id AND a.ts = l.ts""",
           "labels"))
def interval_labels(spark, d):
    return base.labels(spark, d)


@query("a1_interval_means_right_closed", "series_id:s, ts:t, target_part:d, target_all:d",
       sql("""SELECT g.series_id, g.ts, a.target_part, a.target_all
FROM (SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL '240 minutes')) AS ts FROM agg GROUP BY 1) g
LEFT JOIN agg a ON a.series_id = g.series_id AND a.ts = g.ts""", "panel", agg="""SELECT series_id,
  CASE WHEN ts = time_bucket(INTERVAL '240 minutes', ts, TIMESTAMP '1970-01-01') THEN ts
       ELSE time_bucket(INTERVAL '240 minutes', ts, TIMESTAMP '1970-01-01') + INTERVAL '240 minutes' END AS ts,
  avg(target_part) AS target_part, avg(target_all) AS target_all FROM panel GROUP BY 1, 2"""))
def interval_labels_right(spark, d):
    from tidegrid.operators.labels import interval_means
    return interval_means(base.panel(spark, d), base.KEYS, "ts", list(base.TARGETS), base.STEP, 4, closed="right",
                          require_all=False)


@query("u4_forecast_union_contract", "model:s, row_count:i, duplicate_keys:i",
       sql("""SELECT model, count(*) AS row_count, count(*) - count(DISTINCT (fold_id, series_id, origin, target, horizon_minutes))
  AS duplicate_keys FROM forecasts GROUP BY 1""", "forecasts"))
def union_contract(spark, d):
    f = base.forecasts(spark, d)
    keys = ["model", "fold_id", "series_id", "origin", "target", "horizon_minutes"]
    per_key = f.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy("model").agg(F.sum("n").alias("row_count"),
                                        F.sum(F.col("n") - 1).alias("duplicate_keys"))
