"""Metrics, rollups, gates, profiles, drift and event diagnosis."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.functions.horizons import expand_horizons, horizon_bucket, periods_of
from tidegrid.functions.timeline import plus_minutes
from tidegrid.operators import checks, compare, episodes as ep, fits, gates, intervals, metrics, ordering, profile
from tidegrid.plans import base, events_base as ev, joins, windows
from tidegrid.plans.base import HOUR, KEYS, STEP, STRICT, STRICT_SPEC, sql
from tidegrid.plans.joins import CELL, CONTEXT_SQL, CONTROL_SQL, DAYS, OUTCOME_SQL, OUTCOME_SPEC, PAIRS_SQL
from tidegrid.plans.registry import query
from tidegrid.plans.scans import _BUCKET
from tidegrid.session import cut
from tidegrid.sources import readers


@query("a2_strict_metrics", f"model:s, {STRICT_SPEC}", sql(f"SELECT model, {STRICT} FROM forecasts GROUP BY 1", "forecasts"))
def strict(spark, d):
    return base.forecasts(spark, d).groupBy("model").agg(*metrics.strict_errors())


@query("a3_lenient_metrics", "model:s, target:s, mape:d, mae:d, rmse:d, valid_count:i, zero_actual_count:i",
       sql("""SELECT model, target, avg(CASE WHEN actual <> 0 THEN abs((prediction - actual) / actual) END) AS mape, avg(abs(prediction - actual)) AS mae,
  sqrt(avg((prediction - actual) * (prediction - actual))) AS rmse, count(prediction - actual) AS valid_count, count(CASE WHEN actual = 0 AND prediction IS NOT NULL THEN 1 END) AS zero_actual_count
FROM z GROUP BY 1, 2""", "forecasts", z="SELECT model, target, prediction, CASE WHEN actual < 30 THEN 0.0 ELSE actual END AS actual FROM forecasts"))
def lenient(spark, d):
    """Small actuals set to zero, to show that they stay in MAE and RMSE but leave MAPE."""
    f = base.forecasts(spark, d).withColumn("actual", F.when(F.col("actual") < 30, 0.0).otherwise(F.col("actual")))
    return f.groupBy("model", "target").agg(*metrics.lenient_errors())


def _union_scopes(views: dict, source: str, columns: list[str], extra: dict[str, str] | None = None) -> str:
    parts = []
    for scope, cols in views.items():
        picks = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" if c in cols else f"'all' AS {c}" for c in columns)
        where = f" WHERE {extra[scope]}" if extra and scope in extra else ""
        group = ", ".join(str(i + 2) for i, c in enumerate(columns))
        parts.append(f"SELECT '{scope}' AS scope, {picks}, {STRICT} FROM {source}{where} GROUP BY 1, {group}")
    return "\nUNION ALL ".join(parts)


OOF_COLUMNS = ["model", "period", "target", "fold_id", "horizon_minutes"]


@query("a4_scope_rollup", "scope:s, model:s, period:s, target:s, fold_id:s, horizon_minutes:s, " + STRICT_SPEC,
       sql(_union_scopes(metrics.OOF_VIEWS, "forecasts", OOF_COLUMNS), "forecasts"))
def scope_rollup(spark, d):
    return metrics.summarize_forecasts(base.forecasts(spark, d))


ABLATION_COLUMNS = ["variant", "fold_id", "horizon_bucket", "origin_regime", "target_in_event", "target_episode_id"]
VARIANTS_SQL = {
    "c": CONTEXT_SQL,
    "v": f"""SELECT model AS variant, fold_id, series_id, origin, interval_start, target, horizon_minutes, {_BUCKET} AS horizon_bucket, origin_regime, target_in_event, target_episode_id, actual, prediction FROM c
    UNION ALL SELECT 'blend', a.fold_id, a.series_id, a.origin, a.interval_start, a.target, a.horizon_minutes, {_BUCKET.replace('horizon_minutes', 'a.horizon_minutes')}, a.origin_regime, a.target_in_event, a.target_episode_id, a.actual, 0.6 * a.prediction + 0.4 * b.prediction
      FROM c a JOIN c b ON a.model = 'persistence' AND b.model = 'seasonal' AND a.fold_id = b.fold_id AND a.series_id = b.series_id AND a.origin = b.origin AND a.target = b.target AND a.horizon_minutes = b.horizon_minutes""",
}


def variants(spark, d):
    """Both naive models and their blend, with event context and horizon bucket."""
    return cut(build_variants(spark, d))


def build_variants(spark, d):
    c = cut(joins.in_context(spark, d))
    keys = ["fold_id", *KEYS, "origin", "interval_start", "target", "horizon_minutes", "origin_regime", "target_in_event", "target_episode_id"]
    pick = lambda m: F.max(F.when(F.col("model") == m, F.col("prediction")))
    blend = c.groupBy(*keys).agg(F.max("actual").alias("actual"), (pick("persistence") * 0.6 + pick("seasonal") * 0.4).alias("prediction"),
                                 F.lit("blend").alias("variant"))
    both = c.select(*keys, "actual", "prediction", F.col("model").alias("variant")).unionByName(blend)
    return both.withColumn("horizon_bucket", horizon_bucket("horizon_minutes"))


_ABL = _union_scopes(metrics.ABLATION_VIEWS, "v", ABLATION_COLUMNS, {"episode": "target_episode_id <> ''"})


@query("a4_variant_rollup", "scope:s, variant:s, fold_id:s, horizon_bucket:s, origin_regime:s, target_in_event:s, target_episode_id:s, " + STRICT_SPEC,
       sql(_ABL, "forecasts", "episodes", **VARIANTS_SQL))
def variant_rollup(spark, d):
    return metrics.summarize_variants(variants(spark, d))


@query("a5_label_kind_rollup", f"label_kind:s, period:s, model:s, {STRICT_SPEC}",
       sql(f"SELECT label_kind, period, model, {STRICT} FROM u GROUP BY 1, 2, 3", "forecasts", "panel",
           k="SELECT f.*, p.target_all AS point FROM forecasts f LEFT JOIN panel p ON p.series_id = f.series_id AND p.ts = f.origin + to_minutes(CAST(f.horizon_minutes AS BIGINT)) WHERE f.target = 'target_all'",
           x="SELECT 'interval' AS label_kind, horizon_minutes, model, prediction, actual FROM k UNION ALL SELECT 'point', horizon_minutes, model, prediction, point FROM k",
           u="SELECT label_kind, 'long' AS period, model, prediction, actual FROM x UNION ALL SELECT label_kind, 'short', model, prediction, actual FROM x WHERE horizon_minutes <= 480"))
def label_kinds(spark, d):
    """The same forecasts against the interval mean and against the point value, per nested period."""
    p = base.panel(spark, d).select(*KEYS, F.col("ts").alias("target_ts"), F.col("target_all").alias("point"))
    f = base.forecasts(spark, d, ("target_all",)).drop("period").withColumn("target_ts", plus_minutes("origin", F.col("horizon_minutes")))
    both = f.join(p, [*KEYS, "target_ts"], "left").withColumnRenamed("actual", "interval")
    cells = both.select("model", "prediction", "horizon_minutes", F.expr("stack(2, 'interval', interval, 'point', point) AS (label_kind, actual)"))
    cells = cells.withColumn("period", F.explode(periods_of("horizon_minutes", base.SHORT_LIMIT)))
    return cells.groupBy("label_kind", "period", "model").agg(*metrics.strict_errors())


LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_prof = " UNION ALL ".join(f"""SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count, count(CASE WHEN {c} = 0 THEN 1 END) AS zero_count,
  count(CASE WHEN {c} < 0 THEN 1 END) AS negative_count, 0 AS infinite_count, count(CASE WHEN abs({c}) > 50000 THEN 1 END) AS huge_count, min({c}) AS minimum, max({c}) AS maximum,
  min(CASE WHEN {c} IS NOT NULL THEN l_shipdate END) AS first_valid, max(CASE WHEN {c} IS NOT NULL THEN l_shipdate END) AS last_valid, count(DISTINCT {c}) AS distinct_count,
  quantile_cont({c}, 0.01) AS q01, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75, quantile_cont({c}, 0.99) AS q99,
  count({c}) = 0 AS all_empty, count(DISTINCT {c}) <= 1 AS is_constant FROM lineitem""" for c in LINE_COLUMNS)


@query("a6_column_profile", "column_name:s, row_count:i, null_count:i, zero_count:i, negative_count:i, infinite_count:i, huge_count:i, minimum:d, maximum:d, first_valid:t, last_valid:t, distinct_count:i, q01:d, q25:d, q50:d, q75:d, q99:d, all_empty:b, is_constant:b", _prof)
def column_profile(spark, d):
    x = readers.table(spark, d, "lineitem", ["l_shipdate", *LINE_COLUMNS])
    return profile.column_profile(x, "l_shipdate", LINE_COLUMNS, huge=50000)


@query("a7_outlier_candidates", "event_type:s, value_count:i, q25:d, q50:d, q75:d, mad:d, fence_count:i, robust_z_count:i",
       """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75 FROM events GROUP BY 1),
m AS (SELECT e.event_type, quantile_cont(abs(value - q50), 0.5) AS mad FROM events e JOIN q ON q.event_type = e.event_type GROUP BY 1)
SELECT e.event_type, q25, q50, q75, mad, count(value) AS value_count, count(CASE WHEN value < q25 - 1.5 * (q75 - q25) OR value > q75 + 1.5 * (q75 - q25) THEN 1 END) AS fence_count,
  count(CASE WHEN mad > 0 AND abs(value - q50) / (mad * 1.4826) > 6.0 THEN 1 END) AS robust_z_count
FROM events e JOIN q ON q.event_type = e.event_type JOIN m ON m.event_type = e.event_type GROUP BY 1, 2, 3, 4, 5""")
def outliers(spark, d):
    return profile.outlier_candidates(readers.table(spark, d, "events", ["event_type", "value"]), ["event_type"], "value")


@query("a8_duplicate_rows", "kind:s, duplicate_rows:i",
       """SELECT 'key' AS kind, coalesce(sum(n), 0) AS duplicate_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey, l_shipdate HAVING count(*) > 1)
UNION ALL SELECT 'full_row', coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1)""".replace("SELECT count(*) AS n FROM lineitem GROUP BY ALL", "SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"))
def duplicates(spark, d):
    return profile.duplicate_summary(readers.table(spark, d, "lineitem"), ["l_partkey", "l_shipdate"])


@query("a9_time_grid_audit", "o_custkey:i, modal_step:i, first_ts:t, last_ts:t, distinct_moments:i, off_step_count:i, gap_count:i, missing_points:i, first_missing:s",
       """WITH m AS (SELECT DISTINCT o_custkey, o_orderdate AS ts FROM orders),
s AS (SELECT *, lag(ts) OVER (PARTITION BY o_custkey ORDER BY ts) AS p FROM m),
t AS (SELECT *, CAST((epoch(ts) - epoch(p)) // 60 AS BIGINT) AS step FROM s),
k AS (SELECT o_custkey, step, count(*) AS n FROM t WHERE step IS NOT NULL GROUP BY 1, 2),
md AS (SELECT o_custkey, arg_max(step, n * 1000000000.0 - step) AS modal_step FROM k GROUP BY 1),
j AS (SELECT t.*, modal_step FROM t JOIN md ON md.o_custkey = t.o_custkey),
b AS (SELECT o_custkey, modal_step, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS distinct_moments, count(CASE WHEN step <> modal_step THEN 1 END) AS off_step_count,
  count(CASE WHEN step > modal_step THEN 1 END) AS gap_count, sum(CASE WHEN step > modal_step THEN ceil(step / modal_step) - 1 ELSE 0 END) AS missing_points FROM j GROUP BY 1, 2),
g AS (SELECT o_custkey, unnest(generate_series(p + to_minutes(modal_step), least(ts - INTERVAL '1 minute', p + to_minutes(modal_step * 5)), to_minutes(modal_step))) AS x FROM j WHERE step > modal_step),
f AS (SELECT o_custkey, string_agg(strftime(x, '%Y-%m-%d %H:%M'), '|' ORDER BY x) AS first_missing FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY x) AS rn FROM g) WHERE rn <= 5 GROUP BY 1)
SELECT b.*, f.first_missing FROM b LEFT JOIN f ON f.o_custkey = b.o_custkey""")
def grid_audit(spark, d):
    return profile.grid_audit(readers.table(spark, d, "orders", ["o_custkey", "o_orderdate"]), ["o_custkey"], "o_orderdate", shown=5)


@query("a10_table_alignment", "measure:s, moments:i",
       sql("""SELECT 'union' AS measure, count(*) AS moments FROM p UNION ALL SELECT 'intersection', count(*) FROM p WHERE o = 1 AND l = 1 AND e = 1
UNION ALL SELECT 'only:orders', count(*) FROM p WHERE o = 1 AND l + e = 0 UNION ALL SELECT 'only:lineitem', count(*) FROM p WHERE l = 1 AND o + e = 0
UNION ALL SELECT 'only:events', count(*) FROM p WHERE e = 1 AND o + l = 0 UNION ALL SELECT 'pair:orders+lineitem', count(*) FROM p WHERE o = 1 AND l = 1
UNION ALL SELECT 'pair:orders+events', count(*) FROM p WHERE o = 1 AND e = 1 UNION ALL SELECT 'pair:lineitem+events', count(*) FROM p WHERE l = 1 AND e = 1""",
           p="""SELECT ts, max(o) AS o, max(l) AS l, max(e) AS e FROM (SELECT o_orderdate AS ts, 1 AS o, 0 AS l, 0 AS e FROM orders UNION ALL SELECT l_shipdate, 0, 1, 0 FROM lineitem
UNION ALL SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP), 0, 0, 1 FROM events) GROUP BY 1"""))
def alignment(spark, d):
    t = {"orders": readers.table(spark, d, "orders").select(F.col("o_orderdate").alias("ts")),
         "lineitem": readers.table(spark, d, "lineitem").select(F.col("l_shipdate").alias("ts")),
         "events": readers.table(spark, d, "events").select(F.to_date("ts").cast("timestamp_ntz").alias("ts"))}
    return profile.table_alignment(t, "ts")


_shift_cols = ["order_total", "order_count"]


@query("a11_mean_shift", "column_name:s, train_count:i, test_count:i, train_mean:d, test_mean:d, train_std:d, standardized_mean_shift:d",
       sql(" UNION ALL ".join(f"""SELECT '{c}' AS column_name, count(CASE WHEN a THEN {c} END) AS train_count, count(CASE WHEN NOT a THEN {c} END) AS test_count, avg(CASE WHEN a THEN {c} END) AS train_mean,
  avg(CASE WHEN NOT a THEN {c} END) AS test_mean, stddev_samp(CASE WHEN a THEN {c} END) AS train_std, (avg(CASE WHEN NOT a THEN {c} END) - avg(CASE WHEN a THEN {c} END)) / stddev_samp(CASE WHEN a THEN {c} END) AS standardized_mean_shift
FROM s""" for c in _shift_cols), od=DAYS["od"], s="SELECT *, ts <= TIMESTAMP '2000-12-31' AS a FROM od WHERE ts > TIMESTAMP '2000-06-30'"))
def drift_means(spark, d):
    rows = joins.order_days(spark, d)
    cutoff, tail = (F.lit(x).cast("timestamp_ntz") for x in ("2000-12-31", "2000-06-30"))
    return profile.mean_shift(rows.filter((F.col("ts") <= cutoff) & (F.col("ts") > tail)), rows.filter(F.col("ts") > cutoff), _shift_cols)


_sup = " UNION ALL ".join(f"""SELECT '{c}' AS column_name, q.train_n, r.reference_n, t.test_n, t.test_missing_rate, q.train_median, r.reference_median, t.test_median, r.reference_iqr, q.lo AS soft_support_low, q.hi AS soft_support_high,
  CASE WHEN r.reference_iqr > 0 THEN (t.test_median - r.reference_median) / r.reference_iqr END AS median_shift_in_reference_iqr,
  (SELECT avg(CASE WHEN {c} < q.lo THEN 1.0 ELSE 0.0 END) FROM te) + (SELECT avg(CASE WHEN {c} > q.hi THEN 1.0 ELSE 0.0 END) FROM te) AS out_of_support_rate,
  (SELECT avg(CASE WHEN {c} < q.mn THEN 1.0 ELSE 0.0 END) FROM te) + (SELECT avg(CASE WHEN {c} > q.mx THEN 1.0 ELSE 0.0 END) FROM te) AS hard_out_of_range_rate
FROM (SELECT count({c}) AS train_n, quantile_cont({c}, 0.5) AS train_median, quantile_cont({c}, 0.005) AS lo, quantile_cont({c}, 0.995) AS hi, min({c}) AS mn, max({c}) AS mx FROM tr) q,
  (SELECT count({c}) AS reference_n, quantile_cont({c}, 0.5) AS reference_median, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS reference_iqr FROM rf) r,
  (SELECT count({c}) AS test_n, 1.0 - count({c}) / count(*) AS test_missing_rate, quantile_cont({c}, 0.5) AS test_median FROM te) t""" for c in LINE_COLUMNS)


@query("a12_support_shift", "column_name:s, train_n:i, reference_n:i, test_n:i, test_missing_rate:d, train_median:d, reference_median:d, test_median:d, reference_iqr:d, soft_support_low:d, soft_support_high:d, median_shift_in_reference_iqr:d, out_of_support_rate:d, hard_out_of_range_rate:d",
       sql(_sup, tr="SELECT * FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-06-30'", rf="SELECT * FROM lineitem WHERE l_shipdate > TIMESTAMP '2000-01-31' AND l_shipdate <= TIMESTAMP '2000-06-30'", te="SELECT * FROM lineitem WHERE l_shipdate > TIMESTAMP '2000-06-30'"))
def support(spark, d):
    x = readers.table(spark, d, "lineitem", ["l_shipdate", *LINE_COLUMNS])
    a, b = (F.lit(v).cast("timestamp_ntz") for v in ("2000-06-30", "2000-01-31"))
    return profile.support_shift(x.filter(F.col("l_shipdate") <= a), x.filter((F.col("l_shipdate") > b) & (F.col("l_shipdate") <= a)),
                                 x.filter(F.col("l_shipdate") > a), LINE_COLUMNS)


@query("a14_mean_climatology", "series_id:s, dow:i, hour:i, mean:d, samples:i",
       sql("SELECT series_id, extract('isodow' FROM ts) - 1 AS dow, extract('hour' FROM ts) AS hour, avg(target_all) AS mean, count(target_all) AS samples FROM panel GROUP BY 1, 2, 3", "panel"))
def climatology(spark, d):
    return base.panel(spark, d).groupBy(*KEYS, F.weekday("ts").alias("dow"), F.hour("ts").alias("hour")).agg(
        F.avg("target_all").alias("mean"), F.count("target_all").alias("samples"))


@query("a15_event_days", "series_id:s, event_day_id:s, event_date:D, first_flag:t, last_flag:t, flagged_points:i, min_ratio:d", sql("SELECT * FROM event_days", "event_days"))
def event_days(spark, d):
    return ev.days(spark, d)


def _scale_sql(source: str, keys: str) -> str:
    return f"""SELECT {keys}, min(CASE WHEN cw >= tw / 2 THEN ratio END) AS scale FROM (SELECT {keys}, ratio, sum(w) OVER (PARTITION BY {keys} ORDER BY ratio) AS cw, sum(w) OVER (PARTITION BY {keys}) AS tw
    FROM (SELECT {keys}, actual / prediction AS ratio, prediction / actual AS w FROM {source} WHERE actual > 0 AND prediction > 0)) GROUP BY ALL"""


@query("a16_optimal_scale", "model:s, target:s, scale:d", sql(_scale_sql("forecasts", "model, target"), "forecasts"))
def optimal_scale(spark, d):
    return metrics.optimal_scale(base.forecasts(spark, d), ["model", "target"], "actual", "prediction", "scale")


@query("a17_floor_mape", "model:s, target:s, mape:d",
       sql("SELECT model, target, avg(CASE WHEN abs(actual) > 40 THEN abs((prediction - actual) / actual) END) AS mape FROM forecasts GROUP BY 1, 2", "forecasts"))
def floored(spark, d):
    return base.forecasts(spark, d).groupBy("model", "target").agg(metrics.floor_mape("actual", "prediction", 40).alias("mape"))


def _avg_rank(x: str, keys: str) -> str:
    return f"(rank() OVER (PARTITION BY {keys} ORDER BY {x}) + (count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0)"


@query("a18_spearman", "l_returnflag:s, pair_count:i, rho:d",
       f"""SELECT l_returnflag, count(*) AS pair_count, corr(rx, ry) AS rho FROM (SELECT l_returnflag, {_avg_rank('l_quantity', 'l_returnflag')} AS rx, {_avg_rank('l_extendedprice', 'l_returnflag')} AS ry FROM lineitem) GROUP BY 1""")
def rank_correlation(spark, d):
    x = readers.table(spark, d, "lineitem", ["l_returnflag", "l_quantity", "l_extendedprice"])
    return ordering.spearman(x, ["l_returnflag"], "l_quantity", "l_extendedprice", "rho")


@query("a19_rank_auc", "l_linestatus:s, auc:d, positives:i, negatives:i",
       f"""SELECT l_linestatus, (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS auc, sum(y) AS positives, count(*) - sum(y) AS negatives
FROM (SELECT l_linestatus, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, {_avg_rank('l_extendedprice', 'l_linestatus')} AS r FROM lineitem) GROUP BY 1""")
def auc(spark, d):
    x = readers.table(spark, d, "lineitem", ["l_linestatus", "l_returnflag", "l_extendedprice"]).withColumn("y", F.col("l_returnflag") == "R")
    return ordering.rank_auc(x, ["l_linestatus"], "l_extendedprice", "y", "auc")


def _loo_sql(source: str, keys: str) -> str:
    k = [c.strip() for c in keys.split(",")]
    same = " AND ".join(f"b.{c} = a.{c}" for c in k)
    picks = ", ".join(f"a.{c}" for c in k)
    return f"""SELECT {keys}, CASE WHEN tpr IS NULL THEN tnr WHEN tnr IS NULL THEN tpr ELSE (tpr + tnr) / 2 END AS accuracy FROM (
  SELECT {keys}, avg(CASE WHEN y = 1 THEN CASE WHEN said THEN 1.0 ELSE 0.0 END END) AS tpr, avg(CASE WHEN y = 0 THEN CASE WHEN said THEN 0.0 ELSE 1.0 END END) AS tnr FROM (
    SELECT {keys}, id, y, CASE WHEN p >= q THEN v >= (p + q) / 2 ELSE v <= (p + q) / 2 END AS said FROM (
      SELECT {picks}, a.id, a.y, a.v, quantile_cont(CASE WHEN b.y = 1 THEN b.v END, 0.5) AS p, quantile_cont(CASE WHEN b.y = 0 THEN b.v END, 0.5) AS q
      FROM {source} a JOIN {source} b ON {same} AND b.id <> a.id GROUP BY ALL) WHERE p IS NOT NULL AND q IS NOT NULL) GROUP BY ALL)"""


@query("a20_leave_one_out_accuracy", "s_nationkey:i, accuracy:d",
       sql(_loo_sql("x", "s_nationkey"), x="SELECT s_nationkey, s_suppkey AS id, s_acctbal AS v, CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END AS y FROM supplier"))
def leave_one_out(spark, d):
    x = readers.table(spark, d, "supplier").withColumn("y", F.col("s_suppkey") % 3 == 0)
    return ep.leave_one_out_accuracy(x, ["s_nationkey"], "s_acctbal", "y", "accuracy")


SIGNALS = ("target_all", "view")
PRECURSOR_SQL = {
    **CONTROL_SQL,
    "ctl": "SELECT m.series_id, m.episode_id, m.lead_hours, m.origin, s.feature, CASE s.feature WHEN 'view' THEN o.view ELSE o.target_all END AS event_value, CASE s.feature WHEN 'view' THEN c.view ELSE c.target_all END AS control_value FROM matched m CROSS JOIN (SELECT unnest(['target_all', 'view']) AS feature) s JOIN panel o ON o.series_id = m.series_id AND o.ts = m.origin JOIN panel c ON c.series_id = m.series_id AND c.ts = m.control_ts",
    "med": "SELECT series_id, episode_id, lead_hours, origin, feature, any_value(event_value) AS event_value, quantile_cont(control_value, 0.5) AS control_median, stddev_pop(control_value) AS sd, count(*) AS control_count FROM ctl GROUP BY 1, 2, 3, 4, 5",
    "dev": "SELECT c.series_id, c.episode_id, c.lead_hours, c.feature, quantile_cont(abs(c.control_value - m.control_median), 0.5) AS mad FROM ctl c JOIN med m ON m.series_id = c.series_id AND m.episode_id = c.episode_id AND m.lead_hours = c.lead_hours AND m.feature = c.feature GROUP BY 1, 2, 3, 4",
    "pre": """SELECT m.series_id, m.episode_id, m.lead_hours, m.origin, m.feature, event_value, control_median, event_value - control_median AS paired_difference, sc AS control_scale,
    CASE WHEN sc <> 0 THEN greatest(-10.0, least(10.0, (event_value - control_median) / sc)) END AS standardized_difference, control_count
    FROM (SELECT m.*, CASE WHEN d.mad * 1.4826 > 1e-12 THEN d.mad * 1.4826 ELSE m.sd END AS sc FROM med m JOIN dev d ON d.series_id = m.series_id AND d.episode_id = m.episode_id AND d.lead_hours = m.lead_hours AND d.feature = m.feature) m
    WHERE event_value IS NOT NULL AND control_median IS NOT NULL""",
}


def precursors(spark, d):
    """Event origins against their controls, one row per (episode, lead, signal)."""
    p = base.panel(spark, d).select(*KEYS, "ts", *SIGNALS)
    m = joins.matched(spark, d)
    stack = lambda side: F.array(*[F.struct(F.lit(s).alias("feature"), F.col(f"{side}{s}").alias("v")) for s in SIGNALS])
    origin = p.select(*KEYS, F.col("ts").alias("origin"), *[F.col(s).alias(f"o_{s}") for s in SIGNALS])
    control = p.select(*KEYS, F.col("ts").alias("control_ts"), *[F.col(s).alias(f"c_{s}") for s in SIGNALS])
    x = m.join(origin, [*KEYS, "origin"]).join(control, [*KEYS, "control_ts"])
    items = F.array(*[F.struct(F.lit(s).alias("feature"), F.col(f"o_{s}").alias("event_value"), F.col(f"c_{s}").alias("control_value")) for s in SIGNALS])
    x = x.select(*KEYS, "episode_id", "lead_hours", "origin", F.inline(items))
    return cut(ep.precursor_scores(x, [*KEYS, "episode_id", "lead_hours", "origin"], "feature", "event_value", "control_value"))


@query("j11_precursor_scores", "series_id:s, episode_id:s, lead_hours:i, origin:t, feature:s, event_value:d, control_median:d, paired_difference:d, control_scale:d, standardized_difference:d, control_count:i",
       sql("SELECT * FROM pre", "panel", "episodes", **PRECURSOR_SQL))
def precursor_rows(spark, d):
    return precursors(spark, d)


@query("a22_precursor_summary", "lead_hours:i, feature:s, event_samples:i, median_event_value:d, median_control_value:d, median_paired_difference:d, median_standardized_difference:d, positive_fraction:d, direction_consistency:d, effect_score:d",
       sql("""SELECT *, greatest(positive_fraction, 1 - positive_fraction) AS direction_consistency, abs(median_standardized_difference) * greatest(positive_fraction, 1 - positive_fraction) AS effect_score FROM (
  SELECT lead_hours, feature, count(DISTINCT episode_id) AS event_samples, quantile_cont(event_value, 0.5) AS median_event_value, quantile_cont(control_median, 0.5) AS median_control_value,
    quantile_cont(paired_difference, 0.5) AS median_paired_difference, quantile_cont(standardized_difference, 0.5) AS median_standardized_difference, avg(CASE WHEN paired_difference > 0 THEN 1.0 ELSE 0.0 END) AS positive_fraction
  FROM pre GROUP BY 1, 2)""", "panel", "episodes", **PRECURSOR_SQL))
def precursor_summary(spark, d):
    return ep.precursor_summary(precursors(spark, d), ["lead_hours", "feature"], "episode_id")


CLASS_SQL = """SELECT *, coalesce(future_2h_mean_change <= -20, false) AS drop_2h, coalesce(future_6h_mean_change <= -20, false) AS drop_6h, coalesce(future_12h_mean_change <= -20, false) AS drop_12h,
  coalesce(future_24h_mean_change <= -20, false) AS drop_24h, coalesce(future_2h_mean_change <= -20, false) AND coalesce(future_6h_mean_change <= -20, false) AS sustained_drop_6h,
  coalesce(future_2h_mean_change <= -20, false) AND coalesce(future_6h_mean_change <= -20, false) AND coalesce(future_12h_mean_change <= -20, false) AS sustained_drop_12h,
  coalesce(future_2h_mean_change <= -20, false) AND coalesce(future_24h_mean_change > 0, false) AS rebound_by_24h FROM o"""


@query("a23_outcome_classes", "series_id:s, episode_id:s, drop_2h:b, drop_6h:b, drop_12h:b, drop_24h:b, sustained_drop_6h:b, sustained_drop_12h:b, rebound_by_24h:b",
       sql("SELECT * FROM cls", "panel", "episodes", o=OUTCOME_SQL, cls=CLASS_SQL))
def outcome_classes(spark, d):
    return ep.outcome_classes(joins.outcomes(spark, d), -20)


@query("a21_outcome_discrimination", "lead_hours:i, feature:s, event_samples:i, positive_events:i, negative_events:i, positive_median_z:d, negative_median_z:d, rank_auc:d, rank_separation:d, loo_threshold_balanced_accuracy:d, screening_score:d",
       sql(f"""SELECT b.*, u.auc AS rank_auc, abs(u.auc - 0.5) * 2 AS rank_separation, l.accuracy AS loo_threshold_balanced_accuracy, abs(u.auc - 0.5) * 2 * l.accuracy AS screening_score FROM (
  SELECT lead_hours, feature, count(DISTINCT id) AS event_samples, sum(y) AS positive_events, count(*) - sum(y) AS negative_events, quantile_cont(CASE WHEN y = 1 THEN v END, 0.5) AS positive_median_z, quantile_cont(CASE WHEN y = 0 THEN v END, 0.5) AS negative_median_z FROM mg GROUP BY 1, 2) b
LEFT JOIN (SELECT lead_hours, feature, CASE WHEN sum(y) > 0 AND sum(y) < count(*) THEN (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) END AS auc
  FROM (SELECT *, {_avg_rank('v', 'lead_hours, feature')} AS r FROM mg WHERE v IS NOT NULL) GROUP BY 1, 2) u ON u.lead_hours = b.lead_hours AND u.feature = b.feature
LEFT JOIN loo l ON l.lead_hours = b.lead_hours AND l.feature = b.feature""", "panel", "episodes", **PRECURSOR_SQL, o=OUTCOME_SQL, cls=CLASS_SQL,
           mg="SELECT p.lead_hours, p.feature, p.episode_id AS id, p.standardized_difference AS v, CASE WHEN c.drop_6h THEN 1 ELSE 0 END AS y FROM pre p JOIN cls c ON c.episode_id = p.episode_id",
           mv="SELECT * FROM mg WHERE v IS NOT NULL", loo=_loo_sql("mv", "lead_hours, feature")))
def discrimination(spark, d):
    classes = cut(ep.outcome_classes(joins.outcomes(spark, d), -20).select("episode_id", "drop_6h"))
    return ep.outcome_discrimination(precursors(spark, d), classes, ["episode_id"], ["lead_hours", "feature"], "drop_6h", "standardized_difference", "episode_id")


RES_SQL = {"ro": f"""SELECT fold_id, series_id, origin, avg(CASE WHEN b = 'h375_720' THEN (actual - prediction) / abs(actual) END) AS near_r, avg(CASE WHEN b = 'h735_1440' THEN (actual - prediction) / abs(actual) END) AS far_r,
    avg(CASE WHEN b = 'h375_720' THEN actual END) AS near_a, avg(CASE WHEN b = 'h735_1440' THEN actual END) AS far_a
  FROM (SELECT *, {_BUCKET} AS b FROM forecasts WHERE model = 'persistence' AND target = 'target_all' AND actual <> 0 AND prediction IS NOT NULL) GROUP BY 1, 2, 3""",
           "rel": "SELECT *, (far_a - near_a) / greatest(abs(near_a), 1e-6) AS change FROM ro"}


def residuals(spark, d):
    f = base.forecasts(spark, d, ("target_all",)).filter("model = 'persistence'").withColumn("b", horizon_bucket("horizon_minutes"))
    return metrics.residuals_by_origin(f, ["fold_id", *KEYS, "origin"], "b", "h375_720", "h735_1440")


@query("a24_origin_residuals", "fold_id:s, series_id:s, origin:t, near_signed_percentage_residual:d, far_signed_percentage_residual:d, near_actual_mean:d, far_actual_mean:d, far_minus_near_actual_ratio:d",
       sql("SELECT *, near_r AS near_signed_percentage_residual, far_r AS far_signed_percentage_residual, near_a AS near_actual_mean, far_a AS far_actual_mean, change AS far_minus_near_actual_ratio FROM rel", "forecasts", **RES_SQL))
def origin_residuals(spark, d):
    return residuals(spark, d)


def _pressure_scope(scope: str) -> str:
    return f"""SELECT {scope} AS scope, p.boundary_pressure_score AS s, r.far_r, r.change, p.high_zone, p.low_zone, CASE WHEN p.boundary_pressure_score >= 0.1 THEN 'high' WHEN p.boundary_pressure_score <= -0.1 THEN 'low' ELSE 'middle' END AS g
  FROM rel r JOIN pressure p ON p.fold_id = r.fold_id AND p.series_id = r.series_id AND p.ts = r.origin"""


PRESSURE_SQL = {**windows.BOUNDARY_SQL, **RES_SQL, "sc": f"{_pressure_scope(chr(39) + 'pooled' + chr(39))} UNION ALL {_pressure_scope('r.fold_id')}",
                "rk": f"SELECT *, CASE WHEN far_r IS NOT NULL THEN {_avg_rank('s', 'scope, far_r IS NULL')} END AS sr1, CASE WHEN far_r IS NOT NULL THEN {_avg_rank('far_r', 'scope, far_r IS NULL')} END AS fr, CASE WHEN change IS NOT NULL THEN {_avg_rank('s', 'scope, change IS NULL')} END AS sr2, CASE WHEN change IS NOT NULL THEN {_avg_rank('change', 'scope, change IS NULL')} END AS cr FROM sc",
                "pr": """SELECT scope, count(*) AS origin_count, avg(CASE WHEN g = 'high' THEN 1.0 ELSE 0.0 END) AS high_score_fraction, avg(CASE WHEN g = 'low' THEN 1.0 ELSE 0.0 END) AS low_score_fraction,
    avg(CASE WHEN high_zone = 1 OR low_zone = 1 THEN 1.0 ELSE 0.0 END) AS boundary_zone_fraction, (avg(CASE WHEN g = 'high' THEN far_r END) - avg(CASE WHEN g = 'low' THEN far_r END)) * 100.0 AS high_minus_low_far_residual_pct,
    corr(sr1, fr) AS pressure_residual_spearman, corr(sr2, cr) AS pressure_target_change_spearman FROM rk GROUP BY 1"""}


def pressure_relation(spark, d):
    score = windows.pressure(spark, d).select("fold_id", *KEYS, F.col("ts").alias("origin"), "boundary_pressure_score", "high_zone", "low_zone")
    x = cut(residuals(spark, d).join(score, ["fold_id", *KEYS, "origin"]))
    group = F.when(F.col("boundary_pressure_score") >= 0.1, "high").when(F.col("boundary_pressure_score") <= -0.1, "low").otherwise("middle")
    return metrics.pressure_relation(x.withColumn("score_group", group), "fold_id", "boundary_pressure_score", "far_signed_percentage_residual", "far_minus_near_actual_ratio")


@query("a25_pressure_relation", "scope:s, origin_count:i, high_score_fraction:d, low_score_fraction:d, boundary_zone_fraction:d, high_minus_low_far_residual_pct:d, pressure_residual_spearman:d, pressure_target_change_spearman:d",
       sql("SELECT * FROM pr", "panel", "forecasts", "folds", **PRESSURE_SQL))
def pressure_table(spark, d):
    return pressure_relation(spark, d)


@query("a38_inverse_gate", "pooled_far_residual_spearman:d, negative_rho_block_fraction:d, pooled_high_low_far_residual_spread_pct:d, minimum_extreme_group_fraction:d, pass_pooled_rho:b, pass_block_direction:b, pass_pooled_spread:b, pass_coverage:b, gate_passed:b",
       sql("""SELECT *, rho <= 0 AS pass_pooled_rho, neg >= 0.5 AS pass_block_direction, spread <= 0 AS pass_pooled_spread, ext >= 0.05 AS pass_coverage, rho <= 0 AND neg >= 0.5 AND spread <= 0 AND nsp >= 0.5 AND chg <= 0 AND nch >= 0.5 AND ext >= 0.05 AS gate_passed,
  rho AS pooled_far_residual_spearman, neg AS negative_rho_block_fraction, spread AS pooled_high_low_far_residual_spread_pct, ext AS minimum_extreme_group_fraction FROM (
  SELECT max(CASE WHEN scope = 'pooled' THEN pressure_residual_spearman END) AS rho, avg(CASE WHEN scope <> 'pooled' THEN CASE WHEN pressure_residual_spearman < 0 THEN 1.0 ELSE 0.0 END END) AS neg,
    max(CASE WHEN scope = 'pooled' THEN high_minus_low_far_residual_pct END) AS spread, avg(CASE WHEN scope <> 'pooled' THEN CASE WHEN high_minus_low_far_residual_pct < 0 THEN 1.0 ELSE 0.0 END END) AS nsp,
    max(CASE WHEN scope = 'pooled' THEN pressure_target_change_spearman END) AS chg, avg(CASE WHEN scope <> 'pooled' THEN CASE WHEN pressure_target_change_spearman < 0 THEN 1.0 ELSE 0.0 END END) AS nch,
    min(CASE WHEN scope <> 'pooled' THEN least(high_score_fraction, low_score_fraction) END) AS ext FROM pr)""", "panel", "forecasts", "folds", **PRESSURE_SQL))
def inverse_gate(spark, d):
    return gates.inverse_gate(cut(pressure_relation(spark, d)), max_rho=0.0, max_positive_blocks=0.5, max_spread=0.0, max_change=0.0, min_extreme=0.05)


HAZ_SQL = {"hz": "SELECT h.*, CASE WHEN EXISTS (SELECT 1 FROM episodes e WHERE e.series_id = h.series_id AND e.episode_start > h.origin AND e.episode_start <= h.origin + INTERVAL '24 hours') THEN 1 ELSE 0 END AS y FROM hazard h"}


def labelled_hazard(spark, d):
    return intervals.next_event(ev.hazard(spark, d), ev.episodes(spark, d), KEYS, "origin", "episode_start", 1440).withColumn(
        "y", F.col("next_start").isNotNull().cast("int"))


@query("a26_binary_scores", "series_id:s, rows:i, positive_rows:i, brier:d, alert_rate:d, alert_precision:d, alert_recall:d, average_precision:d, prevalence:d, roc_auc:d, average_precision_lift:d",
       sql(f"""SELECT b.*, a.average_precision, b.prev AS prevalence, u.auc AS roc_auc, CASE WHEN b.prev > 0 THEN a.average_precision / b.prev END AS average_precision_lift FROM (
  SELECT series_id, count(*) AS rows, sum(y) AS positive_rows, avg((probability - y) * (probability - y)) AS brier, avg(alert) AS alert_rate, CASE WHEN sum(alert) > 0 THEN sum(alert * y) / sum(alert) END AS alert_precision,
    CASE WHEN sum(y) > 0 THEN sum(alert * y) / sum(y) END AS alert_recall, sum(y) / count(*) AS prev FROM hz GROUP BY 1) b
JOIN (SELECT series_id, CASE WHEN max(tp) > 0 THEN sum(p / tp * cp / cn) END AS average_precision FROM (SELECT series_id, p, sum(p) OVER (PARTITION BY series_id) AS tp, sum(p) OVER (PARTITION BY series_id ORDER BY probability DESC) AS cp, sum(n) OVER (PARTITION BY series_id ORDER BY probability DESC) AS cn
  FROM (SELECT series_id, probability, sum(y) AS p, count(*) AS n FROM hz GROUP BY 1, 2)) GROUP BY 1) a ON a.series_id = b.series_id
JOIN (SELECT series_id, (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS auc FROM (SELECT *, {_avg_rank('probability', 'series_id')} AS r FROM hz) GROUP BY 1) u ON u.series_id = b.series_id""",
           "hazard", "episodes", **HAZ_SQL))
def binary(spark, d):
    return metrics.binary_scores(cut(labelled_hazard(spark, d)), KEYS, "probability", "y", "alert")


@query("a27_alert_threshold", "series_id:s, alert_threshold:d", sql("SELECT series_id, quantile_cont(probability, 0.9) AS alert_threshold FROM hazard GROUP BY 1", "hazard"))
def thresholds(spark, d):
    return metrics.alert_thresholds(ev.hazard(spark, d), KEYS, "probability", 0.1)


@query("a30_log_normalization", "target:s, horizon_minutes:i, series_id:s, origin:t, model:s, standardized:d, restored:d",
       sql("""SELECT f.target, f.horizon_minutes, f.series_id, f.origin, f.model, (CASE WHEN f.actual > 0 THEN ln(f.actual) END - m) / s AS standardized, least(greatest(exp(CASE WHEN f.actual > 0 THEN ln(f.actual) END), 20.0), 180.0) AS restored
FROM forecasts f JOIN (SELECT target, horizon_minutes, avg(CASE WHEN actual > 0 THEN ln(actual) END) AS m, greatest(stddev_pop(CASE WHEN actual > 0 THEN ln(actual) END), 1e-6) AS s FROM forecasts GROUP BY 1, 2) k ON k.target = f.target AND k.horizon_minutes = f.horizon_minutes""", "forecasts"))
def log_scale(spark, d):
    f = base.forecasts(spark, d)
    model = fits.fit_log_scale(f, ["target", "horizon_minutes"], "actual")
    from tidegrid.operators.sizing import lookup_join
    x = lookup_join(f, model, ["target", "horizon_minutes"]).withColumn("standardized", fits.to_log_scale("actual"))
    return x.withColumn("restored", fits.from_log_scale(F.col("standardized"), 20.0, 180.0))


@query("a31_signed_bias", "model:s, target:s, horizon_minutes:i, bias:d, mean_ratio:d",
       sql("""SELECT model, target, horizon_minutes, avg(prediction - actual) AS bias, avg(CASE WHEN actual IS NOT NULL THEN prediction END) / avg(CASE WHEN prediction IS NOT NULL THEN actual END) AS mean_ratio FROM forecasts GROUP BY 1, 2, 3""", "forecasts"))
def bias(spark, d):
    return base.forecasts(spark, d).groupBy("model", "target", "horizon_minutes").agg(*metrics.signed_bias())


@query("a32_bound_violations", "model:s, part_negative:i, part_above_max:i, total_negative:i, total_above_max:i, part_above_total:i",
       sql("""SELECT model, count(CASE WHEN part < 0 THEN 1 END) AS part_negative, count(CASE WHEN part > 60 THEN 1 END) AS part_above_max, count(CASE WHEN total < 0 THEN 1 END) AS total_negative, count(CASE WHEN total > 200 THEN 1 END) AS total_above_max,
  count(CASE WHEN part > total THEN 1 END) AS part_above_total FROM w GROUP BY 1""", "forecasts",
           w="SELECT model, fold_id, series_id, origin, horizon_minutes, max(CASE WHEN target = 'target_part' THEN prediction END) AS part, max(CASE WHEN target = 'target_all' THEN prediction END) AS total FROM forecasts GROUP BY 1, 2, 3, 4, 5"))
def violations(spark, d):
    from tidegrid.functions.blend import bound_violations
    w = base.forecasts(spark, d).groupBy("model", "fold_id", *KEYS, "origin", "horizon_minutes").pivot("target", list(base.TARGETS)).agg(F.max("prediction"))
    counts = bound_violations(F.col("target_part"), F.col("target_all"), 60, 200)
    return w.groupBy("model").agg(*[c.alias(n) for n, c in counts.items()])


@query("a33_horizon_monotonicity", "model:s, target:s, violations:i, horizons:i",
       sql(f"""SELECT model, target, count(CASE WHEN mape < b THEN 1 END) AS violations, count(*) AS horizons FROM (SELECT *, lag(mape) OVER (PARTITION BY model, target ORDER BY horizon_minutes) AS b
  FROM (SELECT model, target, horizon_minutes, {STRICT} FROM forecasts GROUP BY 1, 2, 3)) GROUP BY 1, 2""", "forecasts"))
def monotone(spark, d):
    t = base.forecasts(spark, d).groupBy("model", "target", "horizon_minutes").agg(*metrics.strict_errors())
    return metrics.horizon_monotonicity(t, ["model", "target"])


WEIGHTED = {"p": PAIRS_SQL, "pw": "SELECT p.*, h.probability AS w FROM p JOIN hazard h ON h.series_id = p.series_id AND h.origin = p.origin WHERE control IS NOT NULL AND candidate IS NOT NULL AND actual <> 0"}


@query("a34_weighted_gain", "target:s, control_mape:d, candidate_mape:d, accuracy_gain_pct:d",
       sql("""SELECT target, sum(w * abs((control - actual) / actual)) / sum(w) AS control_mape, sum(w * abs((candidate - actual) / actual)) / sum(w) AS candidate_mape,
  (sum(w * abs((control - actual) / actual)) / sum(w) - sum(w * abs((candidate - actual) / actual)) / sum(w)) * 100.0 AS accuracy_gain_pct FROM pw GROUP BY 1""", "forecasts", "hazard", **WEIGHTED))
def weighted_gain(spark, d):
    w = ev.hazard(spark, d).select(*KEYS, "origin", F.col("probability").alias("w"))
    return metrics.weighted_gain(joins.pairs(spark, d).join(w, [*KEYS, "origin"]), ["target"], "w")


@query("a35_effective_sample_size", "series_id:s, effective_sample_size:d, row_count:i, top_quartile_threshold:d",
       sql("SELECT series_id, sum(probability) * sum(probability) / sum(probability * probability) AS effective_sample_size, count(*) AS row_count, quantile_cont(probability, 0.75) AS top_quartile_threshold FROM hazard GROUP BY 1", "hazard"))
def sample_size(spark, d):
    return metrics.effective_size(ev.hazard(spark, d), KEYS, "probability")


@query("a36_blend_weight_scan", "target:s, best_weight:d, best_mape:d",
       sql("""SELECT target, arg_min(w, mape + w * 1e-13) AS best_weight, min(mape) AS best_mape FROM (SELECT target, w, avg(abs(((1 - w) * control + w * candidate - actual) / actual)) AS mape
  FROM p CROSS JOIN (SELECT unnest(range(0, 21)) * 0.05 AS w) WHERE actual <> 0 AND control IS NOT NULL AND candidate IS NOT NULL GROUP BY 1, 2) GROUP BY 1""", "forecasts", p=PAIRS_SQL))
def blend_scan(spark, d):
    return metrics.scan_weights(joins.pairs(spark, d), ["target"], [round(0.05 * i, 2) for i in range(21)],
                                lambda w: F.col("control") * (1 - w) + F.col("candidate") * w)


@query("a36_shrink_scan", "target:s, best_weight:d, best_mape:d",
       sql("""SELECT target, arg_min(w, mape + w * 1e-13) AS best_weight, min(mape) AS best_mape FROM (SELECT target, w, avg(abs((w * control - actual) / actual)) AS mape
  FROM p CROSS JOIN (SELECT 0.85 + unnest(range(0, 16)) * 0.01 AS w) WHERE actual <> 0 AND control IS NOT NULL GROUP BY 1, 2) GROUP BY 1""", "forecasts", p=PAIRS_SQL))
def shrink_scan(spark, d):
    return metrics.scan_weights(joins.pairs(spark, d), ["target"], [round(0.85 + 0.01 * i, 2) for i in range(16)], lambda w: F.col("control") * w)


@query("a37_block_change", "block:s, cells:i, changed_cells:i, mean_abs_change:d, max_abs_change:d, unchanged:b",
       sql("""SELECT *, changed_cells = 0 AS unchanged FROM (SELECT CASE WHEN target = 'target_part' THEN 'frozen' ELSE 'open' END AS block, count(*) AS cells, count(CASE WHEN a IS DISTINCT FROM b THEN 1 END) AS changed_cells,
  avg(abs(b - a)) AS mean_abs_change, max(abs(b - a)) AS max_abs_change FROM (SELECT target, prediction AS a, CASE WHEN target = 'target_all' THEN prediction * 0.95 ELSE prediction END AS b FROM forecasts WHERE model = 'persistence') GROUP BY 1)""", "forecasts"))
def block_change(spark, d):
    f = base.forecasts(spark, d).filter("model = 'persistence'").select(*CELL, "prediction")
    after = f.withColumn("prediction", F.when(F.col("target") == "target_all", F.col("prediction") * 0.95).otherwise(F.col("prediction")))
    return compare.block_change(f, after, CELL, F.col("target") == "target_part")


_acc = lambda scope, cond="true": f"max(CASE WHEN c.scope = '{scope}' AND {cond} THEN (c.accuracy_1_minus_mape - k.accuracy_1_minus_mape) * 100 END)"
GATE_COLS = ["h375_720", "h735_1440"]


@query("a38_promotion_gate", "variant:s, overall_accuracy_gain_pct:d, ordinary_accuracy_loss_pct:d, recent_fold_mean_gain_pct:d, episode_improvement_fraction:d, evaluated_episode_count:i, h375_720_gain_pct:d, h735_1440_gain_pct:d, pass_overall:b, pass_ordinary:b, pass_recent:b, pass_episodes:b, pass_near_far:b, promotion_gate_passed:b",
       sql("""SELECT *, coalesce(pass_overall AND pass_ordinary AND pass_recent AND pass_episodes AND pass_near_far, false) AS promotion_gate_passed FROM (
  SELECT *, coalesce(overall_accuracy_gain_pct >= 0.1, false) AS pass_overall, coalesce(ordinary_accuracy_loss_pct <= 0.5, false) AS pass_ordinary, coalesce(recent_fold_mean_gain_pct >= 0, false) AS pass_recent,
    coalesce(episode_improvement_fraction > 0.5, false) AS pass_episodes, coalesce(least(h135_360_gain_pct, h735_1440_gain_pct) >= -0.5, false) AS pass_near_far FROM g)""", "forecasts", "episodes", **VARIANTS_SQL, mt=_ABL,
           g=f"""SELECT c.variant, {_acc('overall')} AS overall_accuracy_gain_pct, -{_acc('origin_regime', "c.origin_regime = 'ordinary'")} AS ordinary_accuracy_loss_pct,
    avg(CASE WHEN c.scope = 'fold' AND c.fold_id IN ('fold_2', 'fold_3') THEN (c.accuracy_1_minus_mape - k.accuracy_1_minus_mape) * 100 END) AS recent_fold_mean_gain_pct,
    avg(CASE WHEN c.scope = 'episode' AND k.accuracy_1_minus_mape IS NOT NULL THEN CASE WHEN c.accuracy_1_minus_mape > k.accuracy_1_minus_mape THEN 1.0 ELSE 0.0 END END) AS episode_improvement_fraction,
    count(CASE WHEN c.scope = 'episode' AND k.accuracy_1_minus_mape IS NOT NULL THEN 1 END) AS evaluated_episode_count, {_acc('horizon_bucket', "c.horizon_bucket = 'h135_360'")} AS h135_360_gain_pct,
    {_acc('horizon_bucket', "c.horizon_bucket = 'h375_720'")} AS h375_720_gain_pct, {_acc('horizon_bucket', "c.horizon_bucket = 'h735_1440'")} AS h735_1440_gain_pct
  FROM mt c LEFT JOIN mt k ON k.variant = 'persistence' AND k.scope = c.scope AND k.fold_id = c.fold_id AND k.horizon_bucket = c.horizon_bucket AND k.origin_regime = c.origin_regime AND k.target_in_event = c.target_in_event AND k.target_episode_id = c.target_episode_id
  WHERE c.variant <> 'persistence' GROUP BY 1"""))
def promotion(spark, d):
    m = cut(metrics.summarize_variants(variants(spark, d)))
    return gates.promotion_gate(m, "persistence", ["h135_360", "h375_720", "h735_1440"], ["fold_2", "fold_3"], min_gain=0.1, max_ordinary_loss=0.5)


FIND_SQL = f"""SELECT column_name, 'has_zero' AS code, 'info' AS severity FROM pf WHERE zero_count > 0 UNION ALL SELECT column_name, 'huge_values', 'warning' FROM pf WHERE huge_count > 0
UNION ALL SELECT column_name, 'nulls', 'warning' FROM pf WHERE null_count > 0 UNION ALL SELECT column_name, 'negative', 'error' FROM pf WHERE negative_count > 0"""
RULES = lambda: {"has_zero": ("info", F.col("zero_count") > 0), "huge_values": ("warning", F.col("huge_count") > 0),
                 "nulls": ("warning", F.col("null_count") > 0), "negative": ("error", F.col("negative_count") > 0)}


@query("a39_audit_findings", "column_name:s, code:s, severity:s", sql(FIND_SQL, pf=_prof))
def findings(spark, d):
    return gates.findings(cut(column_profile(spark, d)), RULES())


@query("a39_audit_status", "status:s, errors:i, warnings:i, infos:i",
       sql("""SELECT CASE WHEN sum(CASE WHEN severity = 'error' THEN 1 ELSE 0 END) > 0 THEN 'error' WHEN sum(CASE WHEN severity = 'warning' THEN 1 ELSE 0 END) > 0 THEN 'warning' WHEN count(*) > 0 THEN 'info' ELSE 'ok' END AS status,
  count(CASE WHEN severity = 'error' THEN 1 END) AS errors, count(CASE WHEN severity = 'warning' THEN 1 END) AS warnings, count(CASE WHEN severity = 'info' THEN 1 END) AS infos FROM fs""", pf=_prof, fs=FIND_SQL))
def status(spark, d):
    return gates.overall_status(gates.findings(cut(column_profile(spark, d)), RULES()))


@query("a40_daily_levels", "series_id:s, day:D, forecast_level:d, implied_level:d, gap:d",
       sql("""SELECT f.series_id, f.day, f.l AS forecast_level, p.l AS implied_level, f.l - p.l AS gap FROM (SELECT series_id, CAST(interval_start AS DATE) AS day, avg(prediction) AS l FROM forecasts WHERE model = 'persistence' AND target = 'target_all' GROUP BY 1, 2) f
JOIN (SELECT series_id, CAST(ts AS DATE) AS day, avg(target_all) AS l FROM panel GROUP BY 1, 2) p ON p.series_id = f.series_id AND p.day = f.day""", "forecasts", "panel"))
def daily(spark, d):
    f = base.forecasts(spark, d, ("target_all",)).filter("model = 'persistence'")
    a = metrics.daily_levels(f, KEYS, "interval_start", "prediction", "forecast_level")
    b = metrics.daily_levels(base.panel(spark, d), KEYS, "ts", "target_all", "implied_level")
    return a.join(b, [*KEYS, "day"]).withColumn("gap", F.col("forecast_level") - F.col("implied_level"))


@query("a41_trajectory_shape", "fold_id:s, series_id:s, origin:t, mean_disagreement:d, mean_absolute_disagreement:d, disagreement_std:d, minimum_disagreement:d, maximum_disagreement:d, control_slope:d, candidate_slope:d, control_ape:d, candidate_ape:d, candidate_wins:i",
       sql("""SELECT fold_id, series_id, origin, avg(candidate - control) AS mean_disagreement, avg(abs(candidate - control)) AS mean_absolute_disagreement, stddev_pop(candidate - control) AS disagreement_std, min(candidate - control) AS minimum_disagreement,
  max(candidate - control) AS maximum_disagreement, arg_max(control, horizon_minutes) - arg_min(control, horizon_minutes) AS control_slope, arg_max(candidate, horizon_minutes) - arg_min(candidate, horizon_minutes) AS candidate_slope,
  avg(abs((control - actual) / actual)) AS control_ape, avg(abs((candidate - actual) / actual)) AS candidate_ape, CASE WHEN avg(abs((candidate - actual) / actual)) < avg(abs((control - actual) / actual)) THEN 1 ELSE 0 END AS candidate_wins
FROM p WHERE target = 'target_all' AND actual <> 0 AND control IS NOT NULL AND candidate IS NOT NULL GROUP BY 1, 2, 3""", "forecasts", p=PAIRS_SQL))
def shape(spark, d):
    p = joins.pairs(spark, d).filter("target = 'target_all' AND control IS NOT NULL AND candidate IS NOT NULL")
    return metrics.trajectory_shape(p, ["fold_id", *KEYS, "origin"])
