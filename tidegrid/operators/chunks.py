"""Bounded window frames over arbitrarily long series.

A window partitioned by the series alone puts a whole series into one task. Every frame here is
bounded, so a series is cut into time chunks and the rows within reach of a chunk border are
copied to the neighbour ("halo"). The window partition is then (series, chunk): a hot series
spreads over as many tasks as it has chunks, and the shuffle stays a single exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegrid.functions.timeline import epoch_minutes
from tidegrid.operators.sizing import join_keys

CHUNK = "_chunk"
HOME = "_home"
WEEK = 7 * 1440
TASK_ROWS = 1_000_000   # rows of a window task aimed at, where the rows come straight from files
QUARTER = 91 * 1440


def chunk_of(minutes: Column, length: int) -> Column:
    return F.floor(minutes / length)


def chunk_length(back: int, ahead: int, at_least: int = WEEK) -> int:
    """At least eight times the reach, so that copied rows stay under about an eighth."""
    return max(at_least, 8 * (back + ahead))


def with_halo(df: DataFrame, ts: str, *, back: int = 0, ahead: int = 0,
              length: int | None = None) -> DataFrame:
    """Copy each row to every chunk whose own rows can see it (reach in minutes)."""
    length = length or chunk_length(back, ahead)
    if length <= 0 or back < 0 or ahead < 0:
        raise ValueError("chunk length must be positive and reach non-negative")
    m = epoch_minutes(ts)
    first, last = chunk_of(m - ahead, length), chunk_of(m + back, length)
    return df.select("*", chunk_of(m, length).alias(HOME), F.explode(F.sequence(first, last)).alias(CHUNK))


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter(F.col(HOME) == F.col(CHUNK)).drop(HOME, CHUNK)


def chunk_window(keys: Sequence[str], ts: str, *ties: str):
    return Window.partitionBy(*keys, CHUNK).orderBy(ts, *ties)


def window_tasks(df: DataFrame, rows: int | None = None) -> int | None:
    """Partitions that keep a window task at about ``TASK_ROWS`` rows; None if the session's own number does.

    Compressed grids are a tenth of the size of their sorted rows, so partitions planned by their bytes grow with the
    input. Unless ``rows`` is given, only a written stage is counted, from its files' footers, where that costs no scan.
    """
    if rows is None and df._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        return None
    tasks = -(-(df.count() if rows is None else rows) // TASK_ROWS)
    return tasks if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def windowed(df: DataFrame, keys: Sequence[str], ts: str, stages: Sequence[Callable], *, back: int = 0,
             ahead: int = 0, length: int | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None,
             rows: int | None = None) -> DataFrame:
    """Apply window stages in order; each stage maps a window spec to ``{name: Column}``.

    Later stages may read columns of earlier ones. ``back``/``ahead`` is the total reach of the
    chained frames, in minutes. All stages share one exchange and one sort. ``prepare`` sees the chunks first.
    ``rows``, if known, sets the number of tasks.
    """
    out = with_halo(df, ts, back=back, ahead=ahead, length=length)
    tasks = window_tasks(df, rows)
    if tasks:
        out = out.repartition(tasks, *keys, CHUNK)
    if prepare:
        out = prepare(out)
    w = chunk_window(keys, ts)
    for stage in stages:
        out = out.select("*", *[c.alias(name) for name, c in stage(w).items()])
    return drop_halo(out)


def adjacent(df: DataFrame, keys: Sequence[str], ts: str, out: str, *, length: int = QUARTER,
             direction: int = -1) -> DataFrame:
    """Previous (-1) or next (+1) timestamp of the same series over gaps of any size.

    A gap has no bound, so a halo cannot cover it: chunk borders are bridged through one summary
    row per non-empty chunk.
    """
    keys = list(keys)
    base = df.withColumn(HOME, chunk_of(epoch_minutes(ts), length))
    inside = Window.partitionBy(*keys, HOME).orderBy(ts)
    near = F.lag(ts).over(inside) if direction < 0 else F.lead(ts).over(inside)
    edge = F.max(ts) if direction < 0 else F.min(ts)
    summary = base.groupBy(*keys, HOME).agg(edge.alias("_edge"))
    across = Window.partitionBy(*keys).orderBy(HOME)
    shifted = F.lag("_edge").over(across) if direction < 0 else F.lead("_edge").over(across)
    bridge = summary.select(*keys, HOME, shifted.alias("_bridge"))
    return (join_keys(base.withColumn("_near", near), bridge, [*keys, HOME])
            .withColumn(out, F.coalesce("_near", "_bridge")).drop("_near", "_bridge", HOME))
