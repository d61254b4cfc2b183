"""Interval and point labels, supervised long tables and future trajectories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidegrid.functions.horizons import expand_horizons, interval_start
from tidegrid.functions.timeline import from_epoch_minutes, epoch_minutes, plus_minutes
from tidegrid.operators.chunks import windowed
from tidegrid.operators.grid import complete_grid
from tidegrid.operators.sizing import join_keys


def interval_means(df: DataFrame, keys: Sequence[str], ts: str, targets: Sequence[str], width: int,
                   expected: int, *, closed: str = "left", require_all: bool = True) -> DataFrame:
    """Tumbling means on a gap-free interval grid; NULL unless all ``expected`` samples are there.

    ``closed='right'`` covers ``(T - width, T]`` and is stamped with its end ``T``.
    """
    m = epoch_minutes(ts)
    if closed == "left":
        stamp = F.floor(m / width) * width
    elif closed == "right":
        stamp = F.ceil(m / width) * width
    else:
        raise ValueError("closed must be left or right")
    value = lambda c: F.when(F.count(c) == expected, F.avg(c)) if require_all else F.avg(c)
    table = df.groupBy(*keys, from_epoch_minutes(stamp).alias(ts)).agg(*[value(c).alias(c) for c in targets])
    table = complete_grid(table, keys, ts, width, inserted="interval_inserted")
    return table.select("*", *[F.col(c).isNotNull().alias(f"{c}__complete") for c in targets])


def supervised_long(origins: DataFrame, labels: DataFrame, keys: Sequence[str], horizons: Sequence[int],
                    target: str, width: int, *, how: str = "inner") -> DataFrame:
    """Origin x horizon cells with the label of their interval; ``inner`` drops missing labels.

    The expansion is narrow; the only exchange is the equi-join on (series, interval start).
    """
    cells = expand_horizons(origins, horizons).withColumn(
        "interval_start", interval_start("origin", "horizon_minutes", width))
    y = labels.select(*keys, F.col("ts").alias("interval_start"), F.col(target).alias("actual"))
    if how == "inner":
        y = y.filter(F.col("actual").isNotNull())
    return join_keys(cells, y, [*keys, "interval_start"], how).withColumn("target", F.lit(target))


def wide_labels(cells: DataFrame, keys: Sequence[str], horizons: Sequence[int], target: str) -> DataFrame:
    """One label column per horizon; explicit pivot values, so no extra job to discover them."""
    return (cells.groupBy(*keys, "origin").pivot("horizon_minutes", [int(h) for h in horizons])
            .agg(F.max("actual")).withColumnsRenamed({str(h): f"{target}_t_{h}" for h in horizons}))


def point_labels(df: DataFrame, keys: Sequence[str], ts: str, target: str, steps: Sequence[int],
                 step: int) -> DataFrame:
    """Value ``k`` grid rows after the origin. Labels only: reads the future by definition."""
    return windowed(df, keys, ts, [lambda w: {f"{target}__lead_{k}": F.lead(target, k).over(w) for k in steps}],
                    ahead=max(steps) * step)


def trajectories(cells: DataFrame, keys: Sequence[str], horizons: Sequence[int],
                 out: str = "trajectory") -> DataFrame:
    """Array of future labels in horizon order, NULL elements kept; at most ``len(horizons)`` per group."""
    ordered = F.sort_array(F.collect_list(F.struct("horizon_minutes", "actual")))
    built = cells.groupBy(*keys, "origin").agg(ordered.alias("_t"))
    return built.select(*keys, "origin", F.transform("_t", lambda s: s["actual"]).alias(out)).filter(
        F.size(out) == len(horizons))


def complete_trajectories(table: DataFrame, column: str = "trajectory") -> DataFrame:
    return table.filter(~F.exists(column, lambda v: v.isNull()))


def mature_before(df: DataFrame, origin: str, longest: int, boundary, sample_minutes: int) -> DataFrame:
    """Origins whose longest label is already complete at the boundary."""
    return df.filter(plus_minutes(origin, longest - sample_minutes) <= boundary)
