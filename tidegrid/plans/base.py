"""Panels, labels, folds and forecasts that queries build from the given tables, and their SQL twins.

An event log becomes a keyed hourly panel: 75 neighbouring users form a site, each event type is a
signal (NULL when nothing happened). Targets: ``target_part`` (purchases) and ``target_all`` (all
types). Labels are four-hour means that need all four hours; origins sit on the four-hour grid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegrid.functions.horizons import expand_horizons, interval_start
from tidegrid.functions.numeric import observed_sum
from tidegrid.functions.timeline import floor_minutes, on_grid
from tidegrid.operators.chunks import windowed
from tidegrid.operators.grid import bucket_sums, complete_grid, forward_fill
from tidegrid.operators.labels import interval_means
from tidegrid.operators.splits import Fold, validation_fold
from tidegrid.session import stage
from tidegrid.sources.readers import table

KINDS = ("click", "error", "purchase", "signup", "view")
SITE_USERS = 75
HOUR, STEP, DAY = 60, 240, 1440
HORIZONS = (240, 480, 720, 960, 1200, 1440)
SHORT_LIMIT = 480
KEYS = ["series_id"]
TARGETS = ("target_part", "target_all")
FOLDS = (
    Fold("fold_1", "2024-01-18 23:00:00", "2024-01-19 00:00:00", "2024-01-20 20:00:00"),
    Fold("fold_2", "2024-01-21 23:00:00", "2024-01-22 00:00:00", "2024-01-23 20:00:00"),
    Fold("fold_3", "2024-01-24 23:00:00", "2024-01-25 00:00:00", "2024-01-26 20:00:00"),
    Fold("holdout", "2024-01-27 23:00:00", "2024-01-28 00:00:00", "2024-01-29 20:00:00", "sealed"),
)
DEVELOPMENT = FOLDS[:3]


def site() -> F.Column:
    return F.concat(F.lit("site_"), F.floor(F.col("user_id") / SITE_USERS).cast("string"))


def observations(spark: SparkSession, sf_dir: str, step: int = HOUR) -> DataFrame:
    events = table(spark, sf_dir, "events", ["ts", "user_id", "event_type", "value"])
    return bucket_sums(events.withColumn("series_id", site()), KEYS, "ts", step, "event_type", "value", KINDS)


def panel(spark: SparkSession, sf_dir: str, step: int = HOUR) -> DataFrame:
    return stage(spark, sf_dir, f"panel-{step}", lambda: build_panel(spark, sf_dir, step))


def build_panel(spark: SparkSession, sf_dir: str, step: int = HOUR) -> DataFrame:
    grid = complete_grid(observations(spark, sf_dir, step), KEYS, "ts", step)
    return grid.withColumns({"target_part": F.col("purchase"), "target_all": observed_sum(KINDS)})


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One long series per user: the keyed-panel scale case."""
    return stage(spark, sf_dir, "users", lambda: build_users(spark, sf_dir))


def build_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events", ["ts", "user_id", "value"])
    rows = events.groupBy(F.concat(F.lit("u_"), F.col("user_id").cast("string")).alias("series_id"),
                          floor_minutes("ts", HOUR).alias("ts")).agg(
        F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))
    return complete_grid(rows, KEYS, "ts", HOUR)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, sf_dir, "labels", lambda: interval_means(
        panel(spark, sf_dir), KEYS, "ts", list(TARGETS), STEP, STEP // HOUR))


def origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On-grid rows with the last known targets, carried over at most four missing hours."""
    return origins_source(spark, sf_dir).filter(on_grid("ts", STEP)).withColumnRenamed("ts", "origin")


def origins_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forward_fill(panel(spark, sf_dir), KEYS, "ts", list(TARGETS), 4, HOUR, suffix="__now")


def wide_cells(spark: SparkSession, sf_dir: str, folds=DEVELOPMENT) -> DataFrame:
    """Validation cells with, for both targets, the label, the last known value and the label a day before.

    The day-before label is a lag on the label grid, so labels are joined once.
    """
    o = origins(spark, sf_dir).withColumn("fold_id", validation_fold("origin", folds)).filter("fold_id IS NOT NULL")
    o = o.select(*KEYS, "fold_id", "origin", *[f"{t}__now" for t in TARGETS])
    y = labels_with_day_before(spark, sf_dir)
    x = expand_horizons(o, HORIZONS).withColumn("interval_start", interval_start("origin", "horizon_minutes", STEP))
    return x.join(y, [*KEYS, "interval_start"], "left")


def labels_with_day_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = windowed(labels(spark, sf_dir), KEYS, "ts", [lambda w: {
        f"{t}__day_before": F.lag(t, DAY // STEP).over(w) for t in TARGETS}], back=DAY)
    return y.select(*KEYS, F.col("ts").alias("interval_start"), *TARGETS, *[f"{t}__day_before" for t in TARGETS])


def cells(spark: SparkSession, sf_dir: str, targets=TARGETS, how: str = "inner", folds=DEVELOPMENT) -> DataFrame:
    """Long cells: one row per (fold, series, origin, horizon, target)."""
    per_target = F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).alias("actual"), F.col(f"{t}__now").alias("now"),
                                    F.col(f"{t}__day_before").alias("day_before")) for t in targets])
    out = wide_cells(spark, sf_dir, folds).select("fold_id", *KEYS, "origin", "interval_start", "horizon_minutes",
                                                  F.inline(per_target))
    return out.filter("actual IS NOT NULL") if how == "inner" else out


def forecasts(spark: SparkSession, sf_dir: str, targets=TARGETS) -> DataFrame:
    """Long forecast table of the two naive models on the development folds."""
    table_ = stage(spark, sf_dir, "forecasts", lambda: build_forecasts(spark, sf_dir))
    return table_ if tuple(targets) == TARGETS else table_.filter(F.col("target").isin(list(targets)))


def build_forecasts(spark: SparkSession, sf_dir: str, targets=TARGETS) -> DataFrame:
    models = F.array(F.struct(F.lit("persistence").alias("model"), F.col("now").alias("prediction")),
                     F.struct(F.lit("seasonal").alias("model"), F.col("day_before").alias("prediction")))
    out = cells(spark, sf_dir, targets).select("fold_id", *KEYS, "origin", "interval_start", "target",
                                               "horizon_minutes", "actual", F.inline(models))
    return out.withColumn("period", F.when(F.col("horizon_minutes") <= SHORT_LIMIT, "short").otherwise("long"))


# --- SQL twins -------------------------------------------------------------------------------

_kinds = ",\n    ".join(
    f"CAST(sum(CASE WHEN event_type = '{k}' THEN CAST(value AS DECIMAL(18,2)) END) AS DOUBLE) AS \"{k}\"" for k in KINDS)
_count = " + ".join(f'(CASE WHEN "{k}" IS NULL THEN 0 ELSE 1 END)' for k in KINDS)
_total = " + ".join(f'coalesce("{k}", 0.0)' for k in KINDS)
_folds = ",\n  ".join(f"('{f.fold_id}', {i}, '{f.role}', TIMESTAMP '{f.train_end}', TIMESTAMP '{f.validation_start}', "
                      f"TIMESTAMP '{f.validation_end}')" for i, f in enumerate(FOLDS))
_horizons = ", ".join(str(h) for h in HORIZONS)


def _panel_sql(name: str, minutes: int) -> tuple[str, str]:
    obs = f"""SELECT 'site_' || CAST(user_id // {SITE_USERS} AS VARCHAR) AS series_id,
    time_bucket(INTERVAL '{minutes} minutes', ts, TIMESTAMP '1970-01-01') AS ts,
    {_kinds}
  FROM events GROUP BY 1, 2"""
    grid = f"""SELECT g.series_id, g.ts, {', '.join(f'o."{k}"' for k in KINDS)},
    CASE WHEN o.ts IS NULL THEN 1 ELSE 0 END AS inserted, o.purchase AS target_part,
    CASE WHEN {_count.replace('"', 'o."', 0)} > 0 THEN {_total} END AS target_all
  FROM (SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL '{minutes} minutes')) AS ts
        FROM {name.replace('panel', 'obs')} GROUP BY 1) g
  LEFT JOIN {name.replace('panel', 'obs')} o ON o.series_id = g.series_id AND o.ts = g.ts"""
    return obs, grid


_obs, _panel = _panel_sql("panel", HOUR)
_obs15, _panel15 = _panel_sql("panel15", 15)

FRAGMENTS: dict[str, tuple[tuple[str, ...], str]] = {
    "obs": ((), _obs),
    "panel": (("obs",), _panel),
    "obs15": ((), _obs15),
    "panel15": (("obs15",), _panel15),
    "uobs": ((), """SELECT 'u_' || CAST(user_id AS VARCHAR) AS series_id, date_trunc('hour', ts) AS ts,
    CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2"""),
    "users": (("uobs",), """SELECT g.series_id, g.ts, o.total, CASE WHEN o.ts IS NULL THEN 1 ELSE 0 END AS inserted
  FROM (SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL '60 minutes')) AS ts FROM uobs GROUP BY 1) g
  LEFT JOIN uobs o ON o.series_id = g.series_id AND o.ts = g.ts"""),
    "interval_agg": (("panel",), f"""SELECT series_id, time_bucket(INTERVAL '{STEP} minutes', ts, TIMESTAMP '1970-01-01') AS ts,
    CASE WHEN count(target_part) = 4 THEN avg(target_part) END AS target_part,
    CASE WHEN count(target_all) = 4 THEN avg(target_all) END AS target_all FROM panel GROUP BY 1, 2"""),
    "labels": (("interval_agg",), f"""SELECT g.series_id, g.ts, a.target_part, a.target_all
  FROM (SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL '{STEP} minutes')) AS ts FROM interval_agg GROUP BY 1) g
  LEFT JOIN interval_agg a ON a.series_id = g.series_id AND a.ts = g.ts"""),
    "folds": ((), f"""SELECT * FROM (VALUES
  {_folds}) AS f(fold_id, fold_order, role, train_end, validation_start, validation_end)"""),
    "horizons": ((), f"SELECT unnest([{_horizons}]) AS horizon_minutes"),
    "filled": (("panel",), """SELECT *,
    last_value(target_part IGNORE NULLS) OVER w AS target_part__now,
    last_value(target_all IGNORE NULLS) OVER w AS target_all__now
  FROM panel WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"""),
    "origins": (("filled",), f"""SELECT * RENAME (ts AS origin) FROM filled
  WHERE ts = time_bucket(INTERVAL '{STEP} minutes', ts, TIMESTAMP '1970-01-01')"""),
    "wide_cells": (("origins", "labels", "folds", "horizons"), f"""SELECT f.fold_id, o.series_id, o.origin, h.horizon_minutes,
    o.origin + to_minutes(CAST(h.horizon_minutes - {STEP} AS BIGINT)) AS interval_start, o.target_part__now, o.target_all__now,
    y.target_part, y.target_all, d.target_part AS part_before, d.target_all AS all_before
  FROM origins o JOIN folds f ON f.role = 'development' AND o.origin BETWEEN f.validation_start AND f.validation_end
  CROSS JOIN horizons h
  LEFT JOIN labels y ON y.series_id = o.series_id
    AND y.ts = o.origin + to_minutes(CAST(h.horizon_minutes - {STEP} AS BIGINT))
  LEFT JOIN labels d ON d.series_id = o.series_id
    AND d.ts = o.origin + to_minutes(CAST(h.horizon_minutes - {STEP + DAY} AS BIGINT))"""),
    "cells": (("wide_cells",), """SELECT fold_id, series_id, origin, horizon_minutes, interval_start, 'target_part' AS target,
    target_part AS actual, target_part__now AS now, part_before AS day_before FROM wide_cells WHERE target_part IS NOT NULL
  UNION ALL SELECT fold_id, series_id, origin, horizon_minutes, interval_start, 'target_all',
    target_all, target_all__now, all_before FROM wide_cells WHERE target_all IS NOT NULL"""),
    "forecasts": (("cells",), f"""SELECT fold_id, series_id, origin, interval_start, target, horizon_minutes, actual, model, prediction,
    CASE WHEN horizon_minutes <= {SHORT_LIMIT} THEN 'short' ELSE 'long' END AS period
  FROM (SELECT *, 'persistence' AS model, now AS prediction FROM cells
        UNION ALL SELECT *, 'seasonal', day_before FROM cells)"""),
}


def sql(body: str, *needs: str, **extra: str) -> str:
    """Prefix a body with the fragments it needs (and theirs), then with its own ``extra`` ones."""
    order: list[str] = []

    def visit(name: str) -> None:
        deps, _ = FRAGMENTS[name]
        for d in deps:
            visit(d)
        if name not in order:
            order.append(name)

    for n in needs:
        visit(n)
    parts = [f"{n} AS (\n  {FRAGMENTS[n][1]})" for n in order] + [f"{n} AS (\n  {s})" for n, s in extra.items()]
    return (f"WITH {', '.join(parts)}\n" if parts else "") + body


# Strict error metrics over columns ``actual`` and ``prediction``.
STRICT = """avg(CASE WHEN actual <> 0 AND prediction IS NOT NULL THEN abs((prediction - actual) / actual) END) AS mape,
  1.0 - avg(CASE WHEN actual <> 0 AND prediction IS NOT NULL THEN abs((prediction - actual) / actual) END) AS accuracy_1_minus_mape,
  avg(CASE WHEN actual <> 0 AND prediction IS NOT NULL THEN abs(prediction - actual) END) AS mae,
  sqrt(avg(CASE WHEN actual <> 0 AND prediction IS NOT NULL THEN (prediction - actual) * (prediction - actual) END)) AS rmse,
  count(CASE WHEN actual <> 0 AND prediction IS NOT NULL THEN 1 END) AS valid_count,
  count(CASE WHEN actual = 0 THEN 1 END) AS zero_actual_count,
  count(CASE WHEN actual IS NULL THEN 1 END) AS missing_actual_count,
  count(CASE WHEN prediction IS NULL THEN 1 END) AS missing_prediction_count"""
STRICT_SPEC = ("mape:d, accuracy_1_minus_mape:d, mae:d, rmse:d, valid_count:i, zero_actual_count:i, "
               "missing_actual_count:i, missing_prediction_count:i")
