"""Low-level ratio, event days and episodes of the site panel, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegrid.functions.timeline import on_grid
from tidegrid.operators import episodes as ep, features
from tidegrid.plans import base
from tidegrid.plans.base import FRAGMENTS, HOUR, KEYS
from tidegrid.session import stage

SHORT_ROWS, BASE_ROWS, BASE_MIN, THRESHOLD = 4, 72, 24, 0.55


def ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = features.low_level_ratio("target_all", SHORT_ROWS, BASE_ROWS, BASE_MIN, "ratio")
    return features.build_features(base.panel(spark, sf_dir), KEYS, "ts", HOUR, spec)


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ep.event_days(ratios(spark, sf_dir), KEYS, "ts", "ratio", THRESHOLD)


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, sf_dir, "episodes", lambda: ep.merge_days(days(spark, sf_dir), KEYS))


def hazard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A smooth alert probability per four-hour origin: the lower the ratio, the higher."""
    p = F.lit(1.0) / (F.lit(1.0) + F.exp((F.col("ratio") - 0.75) * 4.0))
    rows = ratios(spark, sf_dir).filter(on_grid("ts", base.STEP)).filter("ratio IS NOT NULL")
    return rows.select(*KEYS, F.col("ts").alias("origin"), "ratio", p.alias("probability")).withColumn(
        "alert", (F.col("probability") >= 0.6).cast("int"))


FRAGMENTS["ratios"] = (("panel",), f"""SELECT series_id, ts, target_all, smooth, CASE WHEN base <> 0 THEN smooth / base END AS ratio FROM (
    SELECT *, CASE WHEN count(smooth) OVER b >= {BASE_MIN} THEN avg(smooth) OVER b END AS base FROM (
      SELECT series_id, ts, target_all, avg(target_all) OVER s AS smooth FROM panel
      WINDOW s AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN {SHORT_ROWS - 1} PRECEDING AND CURRENT ROW))
    WINDOW b AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN {BASE_ROWS - 1} PRECEDING AND CURRENT ROW))""")
FRAGMENTS["event_days"] = (("ratios",), f"""SELECT *, series_id || '_day_' || lpad(CAST(row_number() OVER (PARTITION BY series_id ORDER BY event_date) AS VARCHAR), 2, '0') AS event_day_id
  FROM (SELECT series_id, CAST(ts AS DATE) AS event_date, min(ts) AS first_flag, max(ts) AS last_flag, count(*) AS flagged_points, min(ratio) AS min_ratio
    FROM ratios WHERE ratio < {THRESHOLD} GROUP BY 1, 2)""")
FRAGMENTS["episodes"] = (("event_days",), """SELECT *, series_id || '_episode_' || lpad(CAST(episode_number AS VARCHAR), 2, '0') AS episode_id FROM (
    SELECT series_id, episode_number, min(event_date) AS first_event_date, max(event_date) AS last_event_date, min(first_flag) AS episode_start,
      max(last_flag) AS episode_end, count(*) AS event_day_count, sum(flagged_points) AS flagged_points, min(min_ratio) AS min_ratio,
      string_agg(event_day_id, '|' ORDER BY event_date) AS member_event_day_ids
    FROM (SELECT *, sum(fresh) OVER (PARTITION BY series_id ORDER BY event_date ROWS UNBOUNDED PRECEDING) AS episode_number
      FROM (SELECT *, CASE WHEN event_date - lag(event_date) OVER (PARTITION BY series_id ORDER BY event_date) <= 1 THEN 0 ELSE 1 END AS fresh FROM event_days))
    GROUP BY 1, 2)""")
FRAGMENTS["hazard"] = (("ratios",), """SELECT *, CASE WHEN probability >= 0.6 THEN 1 ELSE 0 END AS alert FROM (
    SELECT series_id, ts AS origin, ratio, 1.0 / (1.0 + exp((ratio - 0.75) * 4.0)) AS probability FROM ratios
    WHERE ratio IS NOT NULL AND ts = time_bucket(INTERVAL '240 minutes', ts, TIMESTAMP '1970-01-01'))""")
