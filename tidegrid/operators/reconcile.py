"""Forecast post-processing along horizons and origins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tidegrid.functions.timeline import epoch_minutes, plus_minutes


def overlap_reconcile(df: DataFrame, keys: Sequence[str], alpha: float, step: int) -> DataFrame:
    """Blend each forecast with the reconciled forecast the previous origin made for the same moment.

    All forecasts of one target moment lie on a diagonal with at most one cell per horizon, so
    they fit one short array that is folded in origin order; a missing origin restarts the fold.
    Parallel over (series, target moment) instead of sequential over origins.
    """
    keys = list(keys)
    item = F.struct(epoch_minutes("origin").alias("m"), "origin", "horizon_minutes", "prediction")
    diagonal = df.groupBy(*keys, plus_minutes("origin", F.col("horizon_minutes")).alias("target_ts")).agg(
        F.sort_array(F.collect_list(item)).alias("_cells"))
    empty = F.expr("CAST(array() AS array<struct<origin:timestamp_ntz,horizon_minutes:int,prediction:double,"
                   "reconciled:double>>)")
    start = F.struct(F.lit(None).cast("bigint").alias("m"), F.lit(None).cast("double").alias("r"), empty.alias("done"))

    def fold(acc, cell):
        linked = acc["m"].isNotNull() & (cell["m"] - acc["m"] == step)
        value = F.when(linked, alpha * cell["prediction"] + (1 - alpha) * acc["r"]).otherwise(cell["prediction"])
        row = F.struct(cell["origin"].alias("origin"), cell["horizon_minutes"].cast("int").alias("horizon_minutes"),
                       cell["prediction"].alias("prediction"), value.alias("reconciled"))
        return F.struct(cell["m"].alias("m"), value.alias("r"), F.concat(acc["done"], F.array(row)).alias("done"))

    folded = F.aggregate("_cells", start, fold, lambda acc: acc["done"])
    return diagonal.select(*keys, "target_ts", F.explode(folded).alias("_c")).select(*keys, "target_ts", "_c.*")


def smooth_horizons(df: DataFrame, keys: Sequence[str], reach: int = 1) -> DataFrame:
    """Centred mean along the horizon axis, shrinking at the edges (a group is one origin)."""
    w = Window.partitionBy(*keys).orderBy("horizon_minutes").rowsBetween(-reach, reach)
    return df.withColumn("smoothed", F.avg("prediction").over(w))


def recursive_rollout(df: DataFrame, history: str, steps: int, lags: Sequence[int], mean_rows: int,
                      out: str = "path") -> DataFrame:
    """Feed one-step forecasts back as lags, with an incrementally updated trailing mean.

    Needs columns ``intercept``, ``beta_lag_<k>`` and ``beta_mean`` and a history array whose last
    element is the origin. Origins do not depend on each other, so the recursion is a fold over
    the steps inside each row.
    """
    length = max([*lags, mean_rows])
    past = F.slice(F.col(history), -length, length)
    total = F.aggregate(F.slice(F.col(history), -mean_rows, mean_rows), F.lit(0.0), lambda a, x: a + x)
    start = F.struct(past.alias("past"), total.alias("total"), F.expr("CAST(array() AS array<double>)").alias("path"))

    def advance(acc, _):
        value = F.col("intercept") + F.col("beta_mean") * acc["total"] / float(mean_rows)
        for k in lags:
            value = value + F.col(f"beta_lag_{k}") * F.element_at(acc["past"], -k)
        value = F.greatest(F.lit(0.0), value)
        return F.struct(F.slice(F.concat(acc["past"], F.array(value)), -length, length).alias("past"),
                        (acc["total"] + value - F.element_at(acc["past"], -mean_rows)).alias("total"),
                        F.concat(acc["path"], F.array(value)).alias("path"))

    ready = df.filter((F.size(history) >= length) & ~F.exists(history, lambda v: v.isNull()))
    return ready.withColumn(out, F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, advance,
                                             lambda acc: acc["path"]))
