"""From irregular observations to a complete, flagged, keyed time grid."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from tidegrid.functions.numeric import finite
from tidegrid.functions.timeline import epoch_minutes, floor_minutes, from_epoch_minutes, on_grid, plus_minutes
from tidegrid.operators.chunks import WEEK, windowed
from tidegrid.operators.sizing import join_keys, lookup_join


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).filter("row_count > 1")


def assert_unique(df: DataFrame, keys: Sequence[str], message: str) -> DataFrame:
    """Same rows, but the job fails when a key repeats. Counts per key in one exchange on the key."""
    per_key = Window.partitionBy(*keys)
    counted = df.withColumn("_n", F.count(F.lit(1)).over(per_key))
    return counted.filter(F.assert_true(F.col("_n") == 1, F.lit(message)).isNull()).drop("_n")


def join_families(families: dict[str, DataFrame], keys: Sequence[str], checked: bool = True) -> DataFrame:
    """Full outer join of source tables on the time key; clashing signal names are refused."""
    seen: dict[str, str] = {}
    for name, df in families.items():
        for column in df.columns:
            if column in keys:
                continue
            if column in seen:
                raise ValueError(f"column {column} occurs in {seen[column]} and {name}")
            seen[column] = name
    frames = [assert_unique(df, keys, f"{name} repeats a key") if checked else df
              for name, df in families.items()]
    return reduce(lambda a, b: join_keys(a, b, list(keys), "full"), frames)


def complete_grid(df: DataFrame, keys: Sequence[str], ts: str, step: int, *,
                  inserted: str = "inserted", chunk: int = WEEK) -> DataFrame:
    """Left join of the gap-free grid of each series to its rows, with a flag for added moments.

    The grid is generated chunk by chunk after a repartition, so a long series is not expanded by
    one task.
    """
    keys = list(keys)
    spans = df.groupBy(*keys).agg(F.min(epoch_minutes(ts)).alias("_lo"), F.max(epoch_minutes(ts)).alias("_hi"))
    pieces = spans.select("*", F.explode(F.sequence(F.floor(F.col("_lo") / chunk), F.floor(F.col("_hi") / chunk))).alias("_piece"))
    first = F.greatest(F.col("_lo"), F.col("_lo") + F.ceil((F.col("_piece") * chunk - F.col("_lo")) / step) * step)
    last = F.least(F.col("_hi"), (F.col("_piece") + 1) * chunk - 1)
    # One opening row a piece knows its first and last moment; each row fills the steps up to the next one.
    opening = (pieces.withColumn("_m", first).withColumn("_last", last).filter("_m <= _last")
               .select(*keys, "_piece", "_m", "_lo", "_last", F.lit(0).alias("_seen")))
    rows = df.withColumn("_m", epoch_minutes(ts)).filter(from_epoch_minutes(F.col("_m")) == F.col(ts))
    rows = rows.withColumns({"_piece": F.floor(F.col("_m") / chunk), "_seen": F.lit(1)})
    piece = Window.partitionBy(*keys, "_piece")
    both = rows.unionByName(opening, allowMissingColumns=True).withColumns({"_lo": F.max("_lo").over(piece), "_last": F.max("_last").over(piece)})
    both = both.filter((F.col("_m") - F.col("_lo")) % step == 0)
    both = both.withColumn("_next", F.lead("_m").over(piece.orderBy("_m", "_seen")))
    start = F.col("_m") + F.col("_seen") * step   # an opening row stands for its own moment unless a row does
    end = F.coalesce(F.col("_next") - step, F.col("_last"))
    steps = F.when(start <= end, F.sequence(start, end, F.lit(step).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    item = lambda m, seen: F.struct(m.alias("m"), F.lit(seen).alias("seen"))
    filled = F.transform(steps, lambda m: item(m, 0))
    filled = F.when(F.col("_seen") == 1, F.concat(F.array(item(F.col("_m"), 1)), filled)).otherwise(filled)
    values = [c for c in df.columns if c not in (*keys, ts)]
    return (both.select(*keys, *values, F.explode(filled).alias("_at"))
            .select(*keys, from_epoch_minutes(F.col("_at.m")).alias(ts),
                    *[F.when(F.col("_at.seen") == 1, F.col(f"`{c}`")).alias(c) for c in values], (1 - F.col("_at.seen")).alias(inserted)))


def sample_on_grid(df: DataFrame, ts: str, step: int) -> DataFrame:
    return df.filter(on_grid(ts, step))


def forward_fill(df: DataFrame, keys: Sequence[str], ts: str, columns: Sequence[str], limit: int, step: int,
                 suffix: str = "") -> DataFrame:
    """Carry the last value over at most ``limit`` missing grid rows, never from later rows."""
    named = [(c, f"{c}{suffix}" if suffix else f"_ff_{c}") for c in columns]
    out = windowed(df, keys, ts, [lambda w: {
        new: F.last(c, ignorenulls=True).over(w.rowsBetween(-limit, 0)) for c, new in named}],
        back=limit * step)
    if not suffix:
        out = out.drop(*columns).withColumnsRenamed({new: c for c, new in named})
    return out


def missing_flags(df: DataFrame, columns: Sequence[str], suffix: str = "__missing") -> DataFrame:
    return df.select("*", *[F.col(c).isNull().cast("int").alias(f"{c}{suffix}") for c in columns])


def ever_active(df: DataFrame, keys: Sequence[str], ts: str, columns: Sequence[str],
                suffix: str = "__active") -> DataFrame:
    """1 from the first non-null sample of a signal on: one small aggregate, no unbounded frame."""
    firsts = df.groupBy(*keys).agg(*[F.min(F.when(F.col(c).isNotNull(), F.col(ts))).alias(f"_first_{c}")
                                     for c in columns])
    joined = lookup_join(df, firsts, list(keys))
    flags = [F.coalesce(F.col(ts) >= F.col(f"_first_{c}"), F.lit(False)).cast("int").alias(f"{c}{suffix}")
             for c in columns]
    return joined.select(*df.columns, *flags)


def null_nonfinite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: finite(c) for c in columns})


def bucket_sums(df: DataFrame, keys: Sequence[str], ts: str, step: int, kind: str, value: str,
                kinds: Sequence[str], scale: int = 2) -> DataFrame:
    """Regular wide observations from an event log: one column per kind, NULL where nothing happened.

    Sums are taken as decimals: the result does not depend on task order, so a recomputed
    partition is bit-identical.
    """
    amount = F.col(value).cast(f"decimal(18,{scale})")
    return (df.groupBy(*keys, floor_minutes(ts, step).alias(ts))
            .agg(*[F.sum(F.when(F.col(kind) == k, amount)).cast("double").alias(k) for k in kinds]))


def contiguous_union(train: DataFrame, test: DataFrame, keys: Sequence[str], ts: str, step: int) -> DataFrame:
    """Train and test rows of each series in one history; the join point must be one step wide.

    A series that is on one side only has no join point: its rows stay as they are, flagged by ``partition``.
    """
    keys = list(keys)
    ends = train.groupBy(*keys).agg(F.max(ts).alias("_end"))
    starts = test.groupBy(*keys).agg(F.min(ts).alias("_start"))
    joined_up = F.assert_true(F.col("_start") == plus_minutes("_end", step), F.lit("train and test are not contiguous"))
    both = train.withColumn("partition", F.lit("train")).unionByName(test.withColumn("partition", F.lit("test")))
    # One row a series is checked, and none of them left: the rows themselves are neither joined nor sorted for it.
    # The outcome is a column and the filter on it, so that neither pruning nor a filter on top loses the check.
    joint = join_keys(ends, starts, keys).select(*keys, joined_up.cast("string").alias("partition")).filter("partition IS NOT NULL")
    return both.unionByName(joint, allowMissingColumns=True)
