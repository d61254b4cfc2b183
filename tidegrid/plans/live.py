"""Streaming forms: each query drains a stream over the table and returns what it emitted."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.functions.timeline import epoch_minutes, from_epoch_minutes, plus_minutes
from tidegrid.plans import base, events_base as ev
from tidegrid.plans.base import HOUR, KEYS, STEP, sql
from tidegrid.plans.registry import query
from tidegrid.session import stage
from tidegrid.streaming import streams


def table_stream(spark, frame):
    """A written stage as a file stream: new files of the folder are new input."""
    path = frame.inputFiles()[0].rsplit("/", 1)[0]
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", streams.FILES).parquet(path)


@query("r1_stream_interval_means", "event_type:s, interval_start:t, samples:i, mean:d",
       """SELECT event_type, time_bucket(INTERVAL '4 hours', ts, TIMESTAMP '1970-01-01') AS interval_start, count(value) AS samples, CASE WHEN count(value) >= 8 THEN avg(value) END AS mean FROM events
GROUP BY 1, 2 HAVING time_bucket(INTERVAL '4 hours', ts, TIMESTAMP '1970-01-01') + INTERVAL '4 hours' <= (SELECT max(ts) FROM events) - INTERVAL '1 hour'""")
def interval_means(spark, d):
    s = streams.open_table(spark, d, "events").select("event_type", "ts", "value")
    return streams.drain(spark, streams.interval_means(s, ["event_type"], "ts", "value", "4 hours", 8, "1 hour"))


@query("r2_stream_sliding_stats", "event_type:s, origin:t, samples:i, mean:d, std_pop:d",
       """SELECT event_type, origin, count(value) AS samples, CASE WHEN count(value) >= 5 THEN avg(value) END AS mean, CASE WHEN count(value) >= 5 THEN stddev_pop(value) END AS std_pop FROM (
  SELECT event_type, value, unnest(generate_series(time_bucket(INTERVAL '2 hours', ts, TIMESTAMP '1970-01-01') + INTERVAL '2 hours', time_bucket(INTERVAL '2 hours', ts, TIMESTAMP '1970-01-01') + INTERVAL '6 hours', INTERVAL '2 hours')) AS origin FROM events)
WHERE origin <= (SELECT max(ts) FROM events) - INTERVAL '1 hour' GROUP BY 1, 2""")
def sliding(spark, d):
    s = streams.open_table(spark, d, "events").select("event_type", "ts", "value")
    return streams.drain(spark, streams.sliding_stats(s, ["event_type"], "ts", "value", "6 hours", "2 hours", 5, "1 hour"))


@query("r3_stream_unique_rows", "user_id:i, rows:i, first_hour:t, last_hour:t",
       "SELECT user_id, count(DISTINCT date_trunc('hour', ts)) AS rows, min(date_trunc('hour', ts)) AS first_hour, max(date_trunc('hour', ts)) AS last_hour FROM events GROUP BY 1")
def unique_rows(spark, d):
    """One row per user and hour; the repeated ones are rejected in the stream."""
    s = streams.open_table(spark, d, "events").select("user_id", "ts", base.floor_minutes("ts", HOUR).alias("hour"))
    kept = streams.drain(spark, streams.unique_rows(s, ["user_id", "hour"], "ts", "2 hours"))
    return kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("rows"), F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour"))


DELAY = "1 day"   # rows of one batch and the next may be that far out of order


def in_time(df, at):
    """Files in the order of time, so that no row is later than the delay when its batch comes."""
    return df.repartitionByRange(16, at).sortWithinPartitions(at)


def closed(df, moment, minutes):
    """With one row of a series of its own, ``minutes`` after the newest: the watermark passes every real row, so all are emitted.

    Nothing comes after the closing row, so it stays behind the watermark itself and never leaves the state.
    """
    end = df.agg((F.max(moment[0]) + minutes).alias("_end")).filter("_end IS NOT NULL")
    end = end.select(F.lit("").alias("series_id"), *[F.col("_end").alias(c) for c in moment])
    return df.unionByName(end, allowMissingColumns=True)


def hourly_values(spark, d):
    return stage(spark, d, "stream-values", lambda: in_time(base.panel(spark, d).select(
        "series_id", epoch_minutes("ts").alias("minute"), F.col("purchase").alias("value")), "minute"))


FILL_SQL = {
    "f": """SELECT series_id, ts, purchase, last_value(purchase IGNORE NULLS) OVER w AS filled, count(purchase) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING) > 0 AS active,
    row_number() OVER (PARTITION BY series_id ORDER BY ts) AS rn FROM panel WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
    "z": "SELECT *, CASE WHEN coalesce(filled, 0) >= 40 THEN 1 ELSE 0 END AS zone FROM f",
}


@query("r4_stream_fill_and_dwell", "series_id:s, ts:t, filled:d, dwell:i, active:i",
       sql("""SELECT series_id, ts, filled, least(6, rn - coalesce(max(CASE WHEN zone = 0 THEN rn END) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING), 0)) AS dwell, CASE WHEN active THEN 1 ELSE 0 END AS active FROM z QUALIFY ts <= max(ts) OVER () - INTERVAL '1 day'""", "panel", **FILL_SQL))
def fill_dwell(spark, d):
    s = table_stream(spark, hourly_values(spark, d))
    out = streams.drain(spark, streams.fill_and_dwell(s, limit_minutes=4 * HOUR, step_minutes=HOUR, zone_above=40.0, cap=6, delay=DELAY))
    return out.withColumn("ts", from_epoch_minutes(F.col("minute")))


def ratio_stage(spark, d):
    return stage(spark, d, "stream-ratios", lambda: ev.ratios(spark, d).select(*KEYS, "ts", "ratio"))


@query("r5_stream_episodes", "series_id:s, episode_start:t, episode_end:t, flagged_points:i, min_ratio:d",
       sql("SELECT series_id, episode_start, episode_end, flagged_points, min_ratio FROM episodes WHERE CAST(last_event_date AS TIMESTAMP) + INTERVAL '36 hours' <= (SELECT CAST(max(event_date) AS TIMESTAMP) FROM event_days)", "episodes"))
def episode_stream(spark, d):
    s = table_stream(spark, ratio_stage(spark, d))
    return streams.drain(spark, streams.episodes(s, KEYS, "ts", "ratio", ev.THRESHOLD, "0 seconds"))


def persistence_stage(spark, d):
    return stage(spark, d, "stream-forecasts", lambda: in_time(closed(base.forecasts(spark, d).filter(
        "model = 'persistence' AND prediction IS NOT NULL").select(
        F.concat_ws("|", "series_id", "fold_id", "target").alias("series_id"), epoch_minutes("origin").alias("origin"),
        (epoch_minutes("origin") + F.col("horizon_minutes")).alias("target"), "prediction"), ["origin", "target"], base.DAY + STEP), "origin"))


@query("r6_stream_reconciliation", "series_id:s, origin:t, target_ts:t, prediction:d, reconciled:d",
       "WITH RECURSIVE " + sql("SELECT series_id || '|' || fold_id || '|' || target AS series_id, origin, target_ts, prediction, reconciled FROM chain", "forecasts",
           f="""SELECT series_id, fold_id, target, origin, prediction, origin + to_minutes(CAST(horizon_minutes AS BIGINT)) AS target_ts FROM forecasts WHERE model = 'persistence' AND prediction IS NOT NULL""",
           linked="""SELECT f.*, p.origin IS NOT NULL AS has_previous FROM f LEFT JOIN f p ON p.series_id = f.series_id AND p.fold_id = f.fold_id AND p.target = f.target AND p.target_ts = f.target_ts AND p.origin = f.origin - INTERVAL '240 minutes'""",
           chain="""SELECT series_id, fold_id, target, origin, target_ts, prediction, prediction AS reconciled FROM linked WHERE NOT has_previous
    UNION ALL SELECT l.series_id, l.fold_id, l.target, l.origin, l.target_ts, l.prediction, 0.7 * l.prediction + 0.3 * c.reconciled FROM linked l JOIN chain c ON c.series_id = l.series_id AND c.fold_id = l.fold_id AND c.target = l.target
      AND c.target_ts = l.target_ts AND l.origin = c.origin + INTERVAL '240 minutes'""").removeprefix("WITH "))
def reconcile_stream(spark, d):
    out = streams.drain(spark, streams.reconcile(table_stream(spark, persistence_stage(spark, d)), alpha=0.7, step_minutes=STEP, delay=DELAY))
    return out.select("series_id", from_epoch_minutes(F.col("origin")).alias("origin"), from_epoch_minutes(F.col("target")).alias("target_ts"),
                      "prediction", "reconciled")


@query("r7_stream_matured_scores", "series_id:s, origin:t, target_ts:t, prediction:d, actual:d, abs_error:d",
       sql("""SELECT f.series_id, f.origin, l.ts AS target_ts, f.prediction, l.target_all AS actual, abs(f.prediction - l.target_all) AS abs_error FROM forecasts f
JOIN labels l ON l.series_id = f.series_id AND l.ts = f.interval_start WHERE f.model = 'persistence' AND f.target = 'target_all' AND f.prediction IS NOT NULL AND l.target_all IS NOT NULL""", "forecasts", "labels"))
def matured(spark, d):
    f = stage(spark, d, "stream-issued", lambda: base.forecasts(spark, d).filter(
        "model = 'persistence' AND target = 'target_all' AND prediction IS NOT NULL").select(*KEYS, "origin", F.col("interval_start").alias("target_ts"), "prediction"))
    y = stage(spark, d, "stream-labels", lambda: base.labels(spark, d).filter("target_all IS NOT NULL").select(
        *KEYS, F.col("ts").alias("label_ts"), F.col("target_all").alias("actual")))
    return streams.drain(spark, streams.score_matured(table_stream(spark, f), table_stream(spark, y), KEYS, "2 days", "24 HOURS"))
