"""Scans, sinks, projections and filters."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidegrid.functions import blend, horizons, numeric, timeline
from tidegrid.functions.calendar import add, calendar_columns, day_harmonics
from tidegrid.functions.numeric import Balance
from tidegrid.operators import features, grid, profile, splits
from tidegrid.plans import base
from tidegrid.plans.base import KEYS, STEP, sql
from tidegrid.plans.registry import query
from tidegrid.session import scratch_root
from tidegrid.sources import readers, reshape, sinks


def fresh_path(spark, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


@query("s1_csv_scan_with_encodings", "encoding:s, row_count:i, total:d, min_priority:s",
       """SELECT 'utf-8' AS encoding, count(*) AS row_count, sum(o_totalprice) / 1000.0 AS total,
  min(o_orderpriority) AS min_priority FROM orders""")
def csv_scan(spark, d):
    path = fresh_path(spark, "orders-csv")
    orders = readers.table(spark, d, "orders", ["o_orderkey", "o_totalprice", "o_orderpriority"])
    orders.write.option("header", True).csv(path)
    back = readers.read_csv(spark, path + "/*.csv", "o_orderkey bigint, o_totalprice double, o_orderpriority string")
    return back.groupBy("encoding").agg(F.count(F.lit(1)).alias("row_count"),
                                        (F.sum("o_totalprice") / 1000.0).alias("total"),
                                        F.min("o_orderpriority").alias("min_priority"))


@query("s2_pruned_scan", "event_type:s, row_count:i, max_value:d",
       "SELECT event_type, count(*) AS row_count, max(value) AS max_value FROM events GROUP BY 1")
def pruned(spark, d):
    return readers.table(spark, d, "events", ["event_type", "value"]).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("row_count"), F.max("value").alias("max_value"))


@query("s3_time_bounded_scan", "event_type:s, row_count:i, first_ts:t, last_ts:t",
       """SELECT event_type, count(*) AS row_count, min(ts) AS first_ts, max(ts) AS last_ts FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00' GROUP BY 1""")
def bounded(spark, d):
    rows = readers.time_slice(readers.table(spark, d, "events", ["ts", "event_type"]), "ts",
                              "2024-01-10 00:00:00", "2024-01-12 12:00:00")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("row_count"), F.min("ts").alias("first_ts"),
                                          F.max("ts").alias("last_ts"))


@query("s4_versioned_write", "version:s, row_count:i, refused:b")
def versioned(spark, d):
    """Writes a version, tries to write it again, and reports the rows and the refusal."""
    root = fresh_path(spark, "versions")
    rows = base.panel(spark, d)
    path = sinks.write_version(rows, root, "v1")
    try:
        sinks.write_version(rows, root, "v1")
        refused = False
    except Exception as error:
        refused = "already exists" in str(error).lower() or "PATH_ALREADY_EXISTS" in str(error)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit("v1").alias("version"), "row_count", F.lit(refused).alias("refused"))


@query("s5_table_fingerprint", "table_name:s, row_count:i, hash_sum:s, hash_xor:i")
def fingerprints(spark, d):
    parts = [readers.table_fingerprint(readers.table(spark, d, n)).withColumn("table_name", F.lit(n))
             for n in ("orders", "lineitem", "events")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("s5_file_fingerprint", "file_name:s, length:i, sha256:s")
def file_hashes(spark, d):
    return readers.file_fingerprints(spark, f"{d}/*.parquet")


WIDE = [f"{t}_{h}" for t in base.TARGETS for h in base.HORIZONS]


@query("s6_formatted_wide_result", "series_id:s, origin:t, " + ", ".join(f"{c}:s" for c in WIDE),
       sql("SELECT series_id, origin, " + ", ".join(f"printf('%.3f', max(CASE WHEN target = '{t}' AND horizon_minutes = {h} THEN prediction END)) AS {t}_{h}" for t in base.TARGETS for h in base.HORIZONS)
           + " FROM forecasts WHERE model = 'persistence' GROUP BY 1, 2", "forecasts"))
def formatted(spark, d):
    """Every target and horizon of every origin; a missing cell stays empty."""
    f = base.forecasts(spark, d).filter("model = 'persistence'")
    wide = reshape.to_wide(f, [*KEYS, "origin"], list(base.TARGETS), list(base.HORIZONS))
    wide = wide.withColumnsRenamed({f"{t}_t+{h}_pred": f"{t}_{h}" for t in base.TARGETS for h in base.HORIZONS})
    path = fresh_path(spark, "result")
    sinks.write_result(wide, path, WIDE, 3)
    schema = "series_id string, origin timestamp_ntz, " + ", ".join(f"{c} string" for c in WIDE)
    return spark.read.schema(schema).option("header", True).csv(path)


@query("s7_run_registry", "run_id:s, cells:i, mape:d",
       sql(f"""SELECT model || '/' || target AS run_id, count(*) AS cells,
  avg(CASE WHEN actual <> 0 AND prediction IS NOT NULL THEN abs((prediction - actual) / actual) END) AS mape
FROM forecasts GROUP BY 1""", "forecasts"))
def run_registry(spark, d):
    """Two batches of runs into a new registry; a repeated id would fail."""
    f = base.forecasts(spark, d)
    a, p = F.col("actual"), F.col("prediction")
    runs = f.groupBy(F.concat_ws("/", "model", "target").alias("run_id"), "target").agg(
        F.count(F.lit(1)).alias("cells"), F.avg(F.when((a != 0) & p.isNotNull(), F.abs((p - a) / a))).alias("mape"))
    path = fresh_path(spark, "registry")
    sinks.append_runs(spark, path, runs.filter("target = 'target_part'").drop("target"))
    return sinks.append_runs(spark, path, runs.filter("target = 'target_all'").drop("target"))


@query("s8_stage_manifest", "stage:s, row_count:i, first_ts:t, last_ts:t, click_nulls:i, purchase_nulls:i, inserted_total:i",
       sql("""SELECT 'grid' AS stage, count(*) AS row_count, min(ts) AS first_ts, max(ts) AS last_ts,
  count(*) - count(click) AS click_nulls, count(*) - count(purchase) AS purchase_nulls, sum(inserted) AS inserted_total
FROM panel""", "panel"))
def stage_manifest(spark, d):
    return sinks.manifest(base.panel(spark, d), "grid", "ts", ["click", "purchase"], ["inserted"])


# Text cells with defects, derived from the whole lineitem table.
_MESSY = ("CASE WHEN l_linenumber = 7 THEN 'n/a' WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN NULL "
          "ELSE CAST(CAST(l_quantity AS INTEGER) AS {text}) || '.5' END")


@query("p1_coerce_numbers", "l_returnflag:s, row_count:i, numeric_count:i, non_numeric:i, total:d",
       f"""SELECT l_returnflag, count(*) AS row_count, count(TRY_CAST(cell AS DOUBLE)) AS numeric_count,
  count(CASE WHEN cell IS NOT NULL AND TRY_CAST(cell AS DOUBLE) IS NULL THEN 1 END) AS non_numeric,
  sum(TRY_CAST(cell AS DOUBLE)) AS total
FROM (SELECT l_returnflag, {_MESSY.format(text='VARCHAR')} AS cell FROM lineitem) GROUP BY 1""")
def coerce(spark, d):
    rows = readers.table(spark, d, "lineitem", ["l_returnflag", "l_linenumber", "l_quantity"]).select(
        "l_returnflag", F.expr(_MESSY.format(text="STRING")).alias("cell"))
    return rows.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("row_count"), F.count(numeric.as_number("cell")).alias("numeric_count"),
        F.count_if(numeric.failed_number("cell")).alias("non_numeric"), F.sum(numeric.as_number("cell")).alias("total"))


@query("p2_mixed_timestamps", "kind:s, row_count:i, parsed:i, first_ts:t, last_ts:t",
       """SELECT o_orderstatus AS kind, count(*) AS row_count, count(CASE WHEN o_orderstatus <> 'P' OR o_custkey % 2 = 0 THEN 1 END) AS parsed,
  min(CASE WHEN o_orderstatus <> 'P' OR o_custkey % 2 = 0 THEN o_orderdate END) AS first_ts,
  max(CASE WHEN o_orderstatus <> 'P' OR o_custkey % 2 = 0 THEN o_orderdate END) AS last_ts FROM orders GROUP BY 1""")
def mixed_times(spark, d):
    """Order dates written in three notations, one of them broken for odd customers, then parsed back."""
    o = readers.table(spark, d, "orders", ["o_orderstatus", "o_orderdate", "o_custkey"])
    text = (F.when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
            .when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy/MM/dd HH:mm"))
            .when(F.col("o_custkey") % 2 == 0, F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise(F.lit("unknown")))
    ts = numeric.mixed_timestamp("text", ["yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm", "dd.MM.yyyy"])
    rows = o.select(F.col("o_orderstatus").alias("kind"), text.alias("text")).withColumn("ts", ts)
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("row_count"), F.count("ts").alias("parsed"),
                                    F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("p4_drop_empty_columns", "series_id:s, ts:t, click:d, view:d",
       sql("SELECT series_id, ts, click, view FROM panel", "panel"))
def drop_empty(spark, d):
    """Signals declared empty leave the table once an aggregate has shown that they are."""
    wide = base.panel(spark, d).select(*KEYS, "ts", "click", "view", F.when(F.col("view") < 0, F.col("view")).alias("spare"))
    return profile.drop_empty_columns(wide, ["spare"])


@query("p5_constant_columns", "column_name:s, is_constant:b",
       """SELECT 'l_quantity' AS column_name, (count(l_quantity) = 0 OR (min(l_quantity) = max(l_quantity) AND count(l_quantity) = count(*))) AS is_constant FROM lineitem
UNION ALL SELECT 'l_tax', (count(l_tax) = 0 OR (min(l_tax) = max(l_tax) AND count(l_tax) = count(*))) FROM lineitem
UNION ALL SELECT 'unit', true FROM lineitem GROUP BY 1, 2
UNION ALL SELECT 'empty', true FROM lineitem GROUP BY 1, 2
UNION ALL SELECT 'half', (count(CASE WHEN l_returnflag = 'A' THEN 1 END) IN (0, count(*))) FROM lineitem""")
def constants(spark, d):
    rows = readers.table(spark, d, "lineitem", ["l_quantity", "l_tax", "l_returnflag"]).withColumns({
        "unit": F.lit(1), "empty": F.lit(None).cast("double"), "half": F.when(F.col("l_returnflag") == "A", 1)})
    return profile.constant_columns(rows, ["l_quantity", "l_tax", "unit", "empty", "half"])


@query("p6_on_grid_sample", "series_id:s, ts:t, target_all__now:d",
       sql("SELECT series_id, origin AS ts, target_all__now FROM origins", "origins"))
def on_grid_rows(spark, d):
    return base.origins(spark, d).withColumnRenamed("origin", "ts")


@query("p7_origin_stride", "series_id:s, ts:t, target_all:d",
       sql("SELECT series_id, ts, target_all FROM panel WHERE (epoch(ts) // 60) % 720 = 0", "panel"))
def stride(spark, d):
    return base.panel(spark, d).filter(timeline.on_stride("ts", 720))


PANEL_FEATURES = [features.lag("click", 1), features.lag("click", 24), features.rolling("click", 6, "mean"),
                  features.rolling("view", 24, "mean"), features.difference("view", 1),
                  features.shifted_label("target_all")]


@query("p8_registry_selection", "feature_name:s, base_signal:s, transform:s, source_offset_min_minutes:i, source_offset_max_minutes:i, row_count:i, value_sum:d",
       sql("""SELECT name AS feature_name, base_signal, transform, lo AS source_offset_min_minutes, hi AS source_offset_max_minutes,
  count(*) AS row_count, sum(v) AS value_sum FROM (
  SELECT 'click__lag_1' AS name, 'click' AS base_signal, 'lag' AS transform, -60 AS lo, -60 AS hi, lag(click, 1) OVER w AS v FROM panel WINDOW w AS (PARTITION BY series_id ORDER BY ts)
  UNION ALL SELECT 'click__lag_24', 'click', 'lag', -1440, -1440, lag(click, 24) OVER w FROM panel WINDOW w AS (PARTITION BY series_id ORDER BY ts)
  UNION ALL SELECT 'view__mean_24', 'view', 'rolling_mean', -1380, 0, CASE WHEN count(view) OVER w = 24 THEN avg(view) OVER w END
    FROM panel WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)
  UNION ALL SELECT 'click__mean_6', 'click', 'rolling_mean', -300, 0, CASE WHEN count(click) OVER w = 6 THEN avg(click) OVER w END
    FROM panel WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))
GROUP BY 1, 2, 3, 4, 5""", "panel"))
def registry_selection(spark, d):
    """Columns named by the registry, selected by signal and transform, then summed per feature."""
    signals, kinds = ["click", "view"], ["lag", "rolling_mean"]
    reg = features.registry(spark, PANEL_FEATURES, base.HOUR)
    chosen = features.select_features(reg, signals, kinds)
    names = features.selected_names(chosen, signals)
    built = features.build_features(base.panel(spark, d), KEYS, "ts", base.HOUR, PANEL_FEATURES).select(*names)
    sums = built.unpivot([], names, "feature_name", "v").groupBy("feature_name").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("v").alias("value_sum"))
    return chosen.join(sums, "feature_name")


@query("p9_observed_sum", "series_id:s, ts:t, observed:i, total:d",
       sql(f"SELECT series_id, ts, {base._count} AS observed, CASE WHEN {base._count} > 0 THEN {base._total} END AS total FROM panel", "panel"))
def observed(spark, d):
    return base.panel(spark, d).select(*KEYS, "ts", numeric.observed_count(base.KINDS).alias("observed"),
                                       numeric.observed_sum(base.KINDS).alias("total"))


@query("p10_filled_sum", "series_id:s, ts:t, total:d", sql(f"SELECT series_id, ts, {base._total} AS total FROM panel", "panel"))
def filled_total(spark, d):
    rows = base.panel(spark, d)
    numeric.require_columns(rows, base.KINDS)
    return rows.select(*KEYS, "ts", numeric.filled_sum(base.KINDS).alias("total"))


@query("p11_balances", "series_id:s, ts:t, strict:d, observed:d, zero:d, balance_total:d",
       sql("""SELECT series_id, ts, strict, observed, zero,
  CASE WHEN strict IS NOT NULL OR observed IS NOT NULL OR zero IS NOT NULL
       THEN coalesce(strict, 0) + coalesce(observed, 0) + coalesce(zero, 0) END AS balance_total
FROM (SELECT series_id, ts, click - purchase AS strict,
  CASE WHEN view IS NOT NULL OR click IS NOT NULL THEN coalesce(view, 0) + coalesce(click, 0) END
  - CASE WHEN error IS NOT NULL OR signup IS NOT NULL THEN coalesce(error, 0) + coalesce(signup, 0) END AS observed,
  coalesce(view, 0) - coalesce(purchase, 0) AS zero FROM panel)""", "panel"))
def balances(spark, d):
    spec = {"strict": Balance(("click",), ("purchase",)),
            "observed": Balance(("view", "click"), ("error", "signup"), "observed"),
            "zero": Balance(("view",), ("purchase",), "zero")}
    return numeric.with_balances(base.panel(spark, d), spec, total="balance_total")


_INVERSE = "CASE WHEN l_discount = 0 THEN CAST('{inf}' AS DOUBLE) WHEN l_tax = 0 THEN CAST('NaN' AS DOUBLE) ELSE l_quantity / l_discount END"


@query("p12_nonfinite_to_null", "l_linestatus:s, row_count:i, finite_count:i, total:d",
       f"""SELECT l_linestatus, count(*) AS row_count, count(v) AS finite_count, sum(v) AS total FROM (
  SELECT l_linestatus, CASE WHEN isfinite(x) THEN x END AS v FROM (
    SELECT l_linestatus, {_INVERSE.format(inf='Infinity')} AS x FROM lineitem)) GROUP BY 1""")
def nonfinite(spark, d):
    rows = readers.table(spark, d, "lineitem", ["l_linestatus", "l_discount", "l_tax", "l_quantity"]).select(
        "l_linestatus", F.expr(_INVERSE.format(inf="Infinity")).alias("v"))
    return grid.null_nonfinite(rows, ["v"]).groupBy("l_linestatus").agg(
        F.count(F.lit(1)).alias("row_count"), F.count("v").alias("finite_count"), F.sum("v").alias("total"))


def _calendar_sql(ts: str, prefix: str = "") -> str:
    minute = f"(extract('hour' FROM {ts}) * 60 + extract('minute' FROM {ts}))"
    dow = f"(extract('isodow' FROM {ts}) - 1)"
    wave = lambda x, n: (f"sin(2 * pi() * {x}) AS {prefix}{n}_sin, cos(2 * pi() * {x}) AS {prefix}{n}_cos")
    return ", ".join([wave(f"{minute} / 1440.0", "hour"), wave(f"extract('minute' FROM {ts}) / 60.0", "minute"),
                      wave(f"{dow} / 7.0", "dayofweek"), f"CASE WHEN {dow} >= 5 THEN 1.0 ELSE 0.0 END AS {prefix}is_weekend",
                      f"extract('month' FROM {ts}) AS {prefix}month", f"extract('day' FROM {ts}) AS {prefix}day_of_month"])


def _calendar_spec(prefix: str = "") -> str:
    names = [f"{n}_{f}" for n in ("hour", "minute", "dayofweek") for f in ("sin", "cos")]
    return ", ".join(f"{prefix}{n}:d" for n in [*names, "is_weekend", "month", "day_of_month"])


@query("p13_origin_calendar", f"event_id:i, {_calendar_spec()}", f"SELECT event_id, {_calendar_sql('ts')} FROM events")
def origin_calendar(spark, d):
    return readers.table(spark, d, "events", ["event_id", "ts"]).select("event_id", *add(calendar_columns("ts")))


@query("p14_day_harmonics", "event_id:i, day1_sin:d, day1_cos:d, day2_sin:d, day2_cos:d",
       """SELECT event_id, sin(2 * pi() * x) AS day1_sin, cos(2 * pi() * x) AS day1_cos, sin(4 * pi() * x) AS day2_sin,
  cos(4 * pi() * x) AS day2_cos FROM (SELECT event_id, (extract('hour' FROM ts) * 60 + extract('minute' FROM ts)) / 1440.0 AS x FROM events)""")
def harmonics(spark, d):
    return readers.table(spark, d, "events", ["event_id", "ts"]).select("event_id", *add(day_harmonics("ts")))


@query("p15_target_calendar", f"series_id:s, origin:t, horizon_minutes:i, {_calendar_spec('target_')}",
       sql(f"""SELECT series_id, origin, horizon_minutes, {_calendar_sql('interval_start', 'target_')} FROM (
  SELECT o.series_id, o.origin, h.horizon_minutes, o.origin + to_minutes(CAST(h.horizon_minutes - {STEP} AS BIGINT)) AS interval_start
  FROM origins o CROSS JOIN horizons h)""", "origins", "horizons"))
def target_calendar(spark, d):
    x = horizons.expand_horizons(base.origins(spark, d).select(*KEYS, "origin"), base.HORIZONS)
    x = x.withColumn("interval_start", horizons.interval_start("origin", "horizon_minutes", STEP))
    return x.select(*KEYS, "origin", "horizon_minutes", *add(calendar_columns("interval_start", "target_")))


@query("p16_point_target_calendar", f"series_id:s, origin:t, horizon_minutes:i, {_calendar_spec('target_')}",
       sql(f"""SELECT series_id, origin, horizon_minutes, {_calendar_sql('target_ts', 'target_')} FROM (
  SELECT o.series_id, o.origin, h.horizon_minutes, o.origin + to_minutes(CAST(h.horizon_minutes AS BIGINT)) AS target_ts
  FROM origins o CROSS JOIN horizons h)""", "origins", "horizons"))
def point_calendar(spark, d):
    x = horizons.expand_horizons(base.origins(spark, d).select(*KEYS, "origin"), base.HORIZONS)
    x = x.withColumn("target_ts", timeline.plus_minutes("origin", F.col("horizon_minutes")))
    return x.select(*KEYS, "origin", "horizon_minutes", *add(calendar_columns("target_ts", "target_")))


_BUCKET = """CASE WHEN horizon_minutes <= 120 THEN 'h015_120' WHEN horizon_minutes <= 360 THEN 'h135_360'
  WHEN horizon_minutes <= 720 THEN 'h375_720' WHEN horizon_minutes <= 1440 THEN 'h735_1440' END"""
_BAND = """CASE WHEN period = 'short' THEN (CASE WHEN horizon_minutes <= 240 THEN 'near' WHEN horizon_minutes <= 480 THEN 'mid' END)
  WHEN period = 'long' THEN (CASE WHEN horizon_minutes <= 960 THEN 'mid' WHEN horizon_minutes <= 1440 THEN 'far' END) END"""


@query("p17_horizon_buckets", "horizon_bucket:s, horizon_band:s, cells:i, largest:i",
       sql(f"SELECT {_BUCKET} AS horizon_bucket, {_BAND} AS horizon_band, count(*) AS cells, max(horizon_minutes) AS largest FROM forecasts GROUP BY 1, 2", "forecasts"))
def buckets(spark, d):
    band = horizons.horizon_band("period", "horizon_minutes", {"short": [(240, "near"), (480, "mid")],
                                                              "long": [(960, "mid"), (1440, "far")]})
    return base.forecasts(spark, d).groupBy(horizons.horizon_bucket("horizon_minutes").alias("horizon_bucket"),
                                            band.alias("horizon_band")).agg(
        F.count(F.lit(1)).alias("cells"), F.max("horizon_minutes").alias("largest"))


@query("p18_interval_bounds", "series_id:s, origin:t, horizon_minutes:i, interval_start:t, interval_end:t",
       sql(f"""SELECT o.series_id, o.origin, h.horizon_minutes, o.origin + to_minutes(CAST(h.horizon_minutes - {STEP} AS BIGINT)) AS interval_start,
  o.origin + to_minutes(CAST(h.horizon_minutes AS BIGINT)) AS interval_end FROM origins o CROSS JOIN horizons h""", "origins", "horizons"))
def bounds(spark, d):
    x = horizons.expand_horizons(base.origins(spark, d).select(*KEYS, "origin"), base.HORIZONS)
    first = x.withColumns({"interval_start": horizons.interval_bounds("origin", "horizon_minutes", STEP)["interval_start"]})
    return first.withColumn("interval_end", timeline.plus_minutes("interval_start", STEP))


@query("p19_restore_raw_names", "series_id:s, ts:t, clicks_raw:d, views_raw:d",
       sql("SELECT series_id, ts, click AS clicks_raw, view AS views_raw FROM panel", "panel"))
def raw_names(spark, d):
    feats = features.recent_lags(["click", "view"], [1], [2])
    built = features.build_features(base.panel(spark, d), KEYS, "ts", base.HOUR, feats)
    return reshape.restore_names(built, [*KEYS, "ts"], {"click__current": "clicks_raw", "view__current": "views_raw"})


@query("p20_date_block_mask", "series_id:s, day_rows:i, masked_cells:i, masked_prediction:d",
       sql("""SELECT series_id, count(CASE WHEN CAST(origin AS DATE) BETWEEN DATE '2024-01-22' AND DATE '2024-01-23' THEN 1 END) AS day_rows,
  count(CASE WHEN interval_start BETWEEN TIMESTAMP '2024-01-22 12:00:00' AND TIMESTAMP '2024-01-23 08:00:00' THEN 1 END) AS masked_cells,
  sum(CASE WHEN interval_start BETWEEN TIMESTAMP '2024-01-22 12:00:00' AND TIMESTAMP '2024-01-23 08:00:00' THEN prediction END) AS masked_prediction
FROM forecasts GROUP BY 1""", "forecasts"))
def date_mask(spark, d):
    day = F.to_date("origin").between(F.lit("2024-01-22").cast("date"), F.lit("2024-01-23").cast("date"))
    mask = F.col("interval_start").between(F.lit("2024-01-22 12:00:00").cast("timestamp_ntz"),
                                           F.lit("2024-01-23 08:00:00").cast("timestamp_ntz"))
    return base.forecasts(spark, d).groupBy(*KEYS).agg(
        F.count_if(day).alias("day_rows"), F.count_if(mask).alias("masked_cells"),
        F.sum(F.when(mask, F.col("prediction"))).alias("masked_prediction"))


@query("p21_not_yet_active_as_zero", "series_id:s, ts:t, signup:d",
       sql("SELECT series_id, ts, coalesce(signup, 0.0) AS signup FROM panel", "panel"))
def inactive_zero(spark, d):
    return base.panel(spark, d).select(*KEYS, "ts", F.coalesce("signup", F.lit(0.0)).alias("signup"))


@query("p22_latest_mature_origin", "fold_id:s, horizon_minutes:i, by_formula:t, latest_interval:t, latest_point:t",
       sql(f"""SELECT f.fold_id, h.horizon_minutes,
  max(CASE WHEN o.origin + to_minutes(CAST(h.horizon_minutes - 60 AS BIGINT)) <= f.train_end THEN o.origin END) AS by_formula,
  max(CASE WHEN o.origin + to_minutes(CAST(h.horizon_minutes - 60 AS BIGINT)) <= f.train_end THEN o.origin END) AS latest_interval,
  max(CASE WHEN o.origin + to_minutes(CAST(h.horizon_minutes AS BIGINT)) <= f.train_end THEN o.origin END) AS latest_point
FROM origins o CROSS JOIN horizons h CROSS JOIN folds f GROUP BY 1, 2""", "origins", "horizons", "folds"))
def mature(spark, d):
    """The last mature origin found in the data equals the closed formula."""
    x = horizons.expand_horizons(base.origins(spark, d).select("origin"), base.HORIZONS)
    kinds = []
    for f in base.FOLDS:
        end = F.lit(f.train_end).cast("timestamp_ntz")
        ok = lambda interval: horizons.is_mature("origin", "horizon_minutes", end, interval=interval, sample_minutes=60)
        kinds.append(F.struct(F.lit(f.fold_id).alias("fold_id"),
                              F.max(F.when(ok(True), F.col("origin"))).alias("latest_interval"),
                              F.max(F.when(ok(False), F.col("origin"))).alias("latest_point"),
                              end.alias("train_end")))
    table = x.groupBy("horizon_minutes").agg(F.array(*kinds).alias("_k")).select("horizon_minutes", F.inline("_k"))
    formula = F.lit(None).cast("timestamp_ntz")
    for h in base.HORIZONS:
        formula = F.when(F.col("horizon_minutes") == h, splits.latest_mature_origin(F.col("train_end"), h, STEP, 60)
                         ).otherwise(formula)
    return table.withColumn("by_formula", formula)


@query("p24_available_features", "feature_name:s, base_signal:s, causal:b",
       """SELECT * FROM (VALUES ('click__lag_1', 'click', true), ('click__lag_24', 'click', true), ('click__mean_6', 'click', true),
  ('view__mean_24', 'view', true), ('view__diff_1', 'view', true)) AS r(feature_name, base_signal, causal)
WHERE (SELECT count(*) FROM events) > 0""")
def available(spark, d):
    """Registry rows usable at prediction time whose base signal the panel really has."""
    reg = features.available_features(features.registry(spark, PANEL_FEATURES, base.HOUR))
    rows = base.panel(spark, d).agg(*[F.count_if(F.col(c).isNotNull()).alias(c) for c in base.KINDS])
    seen = rows.unpivot([], list(base.KINDS), "base_signal", "n").filter("n > 0")
    return reg.join(seen, "base_signal", "left_semi")
