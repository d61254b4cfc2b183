"""Backtest layout: folds are rows, not loops."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidegrid.functions.horizons import expand_horizons, horizon_groups
from tidegrid.functions.timeline import epoch_minutes, plus_minutes
from tidegrid.operators.ordering import prefix_sums
from tidegrid.operators.sizing import join_keys, lookup_join
from tidegrid.session import cut

FOLD_SCHEMA = ("fold_id string, fold_order int, role string, train_end timestamp_ntz, "
               "validation_start timestamp_ntz, validation_end timestamp_ntz")


@dataclass(frozen=True)
class Fold:
    fold_id: str
    train_end: str
    validation_start: str
    validation_end: str
    role: str = "development"


def fold_table(spark: SparkSession, folds: Sequence[Fold]) -> DataFrame:
    rows = [(f.fold_id, i, f.role, f.train_end, f.validation_start, f.validation_end) for i, f in enumerate(folds)]
    raw = spark.createDataFrame(rows, "fold_id string, fold_order int, role string, train_end string, "
                                      "validation_start string, validation_end string")
    stamps = {c: F.col(c).cast("timestamp_ntz") for c in ("train_end", "validation_start", "validation_end")}
    return raw.withColumns(stamps)


def assignments(folds: DataFrame, step: int, horizons: Sequence[int], sample_minutes: int) -> DataFrame:
    """One row per (fold, validation origin) with label ends and the latest train origin that is mature."""
    lo, hi = epoch_minutes("validation_start"), epoch_minutes("validation_end")
    origin = F.explode(F.sequence(lo, hi, F.lit(step).cast("bigint")))
    out = folds.select("fold_id", "fold_order", "role", "train_end", "validation_start", "validation_end",
                       origin.alias("_m"))
    out = out.withColumn("origin", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, int(_m), 0)"))
    return out.drop("_m").withColumns({
        "short_label_end": plus_minutes("origin", min(horizons) - sample_minutes),
        "long_label_end": plus_minutes("origin", max(horizons) - sample_minutes),
        "latest_train_origin": latest_mature_origin(F.col("train_end"), max(horizons), step, sample_minutes)})


def latest_mature_origin(train_end: Column, horizon: int, step: int, sample_minutes: int,
                         interval: bool = True) -> Column:
    """Last aligned origin whose whole label lies at or before ``train_end``."""
    last = epoch_minutes(train_end) - horizon + (sample_minutes if interval else 0)
    aligned = F.floor(last / step) * step
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), aligned.cast("int"), F.lit(0).cast("decimal(18,6)"))


def layout_problems(table: DataFrame, step: int) -> DataFrame:
    """Rows breaking order, alignment or separation of train and validation."""
    checks = [("origin_not_after_train_end", F.col("origin") <= F.col("train_end")),
              ("origin_off_grid", epoch_minutes("origin") % step != 0),
              ("train_label_past_train_end", F.col("latest_train_origin") > F.col("train_end"))]
    items = F.array(*[F.when(c, F.lit(n)) for n, c in checks])
    return table.select("fold_id", "origin", F.explode(F.filter(items, lambda x: x.isNotNull())).alias("problem"))


def block_layout(blocks: DataFrame, reserved: DataFrame, step: int, expected: int) -> DataFrame:
    """Per block: origin count, completeness, overlap with other blocks and with reserved origins."""
    span = lambda d: d.select("fold_id", F.explode(F.sequence(
        epoch_minutes("validation_start"), epoch_minutes("validation_end"), F.lit(step).cast("bigint"))).alias("_m"))
    mine = span(blocks)
    shared = mine.groupBy("_m").agg(F.count(F.lit(1)).alias("_blocks"))
    used = span(reserved).select("_m").distinct().withColumn("_used", F.lit(1))
    marked = mine.join(shared, "_m").join(used, "_m", "left")
    table = marked.groupBy("fold_id").agg(
        F.count(F.lit(1)).alias("origin_count"), F.count_if(F.col("_blocks") > 1).alias("shared_origins"),
        F.count("_used").alias("reserved_origins"))
    ok = (F.col("origin_count") == expected) & (F.col("shared_origins") == 0) & (F.col("reserved_origins") == 0)
    return table.withColumn("layout_ok", ok)


def expanding_pairs(spark: SparkSession, folds: Sequence[Fold]) -> DataFrame:
    """(train fold, validation fold) pairs for a second-stage model trained on all earlier folds."""
    pairs = [(v.fold_id, t.fold_id) for i, v in enumerate(folds) for t in folds[:i]]
    return spark.createDataFrame(pairs, "validation_fold string, train_fold string")


def grouped_folds(df: DataFrame, day: str, label: str, k: int, seed: int) -> DataFrame:
    """Fold number per day, balanced over the classes: whole days stay together.

    Days are dealt out in the order of a seeded hash within their class, by their running count.
    """
    days = cut(df.groupBy(day).agg(F.max(label).alias("_class")).withColumns({
        "_h": F.conv(F.substring(F.md5(F.concat(F.col(day).cast("string"), F.lit(f"/{seed}")).cast("binary")), 1, 13), 16, 10).cast("bigint"), "n": F.lit(1)}))
    ranked = prefix_sums(days, ["_class"], "_h", ["n"]).select(
        "_class", "_h", F.pmod(F.col("n_below"), F.lit(k)).cast("int").alias("fold"))
    return lookup_join(df, join_keys(days, ranked, ["_class", "_h"]).select(day, "fold"), [day])


def embargo_folds(episodes: DataFrame, fold: str, horizons: Sequence[int]) -> DataFrame:
    """Leave-episode-out bounds per fold and horizon.

    Validation origins lie in [validation_start, validation_end): from the longest horizon before the first
    held-out episode until the last one starts. An origin may train while its label, a horizon later, is
    known by then: up to train_end, itself included.
    """
    starts = episodes.groupBy(fold).agg(F.min("episode_start").alias("_first"), F.max("episode_start").alias("validation_end"))
    starts = starts.withColumn("validation_start", plus_minutes("_first", -max(horizons)))
    return starts.select(fold, F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon_minutes"), "validation_start", "validation_end").withColumn(
        "train_end", plus_minutes("validation_start", -F.col("horizon_minutes")))


def counted_until(moments: DataFrame, marks: DataFrame, at: str, out: str, *, inclusive: bool) -> DataFrame:
    """``marks`` with the sum of ``n`` over the ``moments(ts, n)`` up to their moment ``at``.

    One running sum over distinct moments and marks together: their number grows with the time
    covered, not with the number of rows, so it is small enough for one window.
    """
    ids = [c for c in marks.columns]
    rows = moments.select(F.col("ts").alias("_at"), "n", F.lit(1).alias("_rank"), F.lit(None).cast(marks.select(F.struct(*ids)).schema[0].dataType).alias("_mark"))
    asked = marks.select(F.col(at).alias("_at"), F.lit(0).cast("bigint").alias("n"), F.lit(2 if inclusive else 0).alias("_rank"), F.struct(*ids).alias("_mark"))
    upto = Window.orderBy("_at", "_rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.unionByName(asked).withColumn(out, F.sum("n").over(upto)).filter("_mark IS NOT NULL").select("_mark.*", out)


def cohort_table(spark: SparkSession, horizons: Sequence[int], size: int) -> DataFrame:
    return spark.createDataFrame(sorted(horizon_groups(horizons, size).items()),
                                 "horizon_minutes int, cohort int")


def recent_window(df: DataFrame, keys: Sequence[str], ts: str, rows: int, step: int) -> DataFrame:
    """The latest ``rows`` origins of each series, which must be gap-free.

    Only the maximum is aggregated; the rest is a filter by time, so nothing is sorted.
    """
    keys = list(keys)
    last = df.groupBy(*keys).agg(F.max(ts).alias("_last"))
    kept = lookup_join(df, last, keys).filter(epoch_minutes(ts) > epoch_minutes("_last") - rows * step)
    counts = kept.groupBy(*keys).agg(F.count_distinct(ts).alias("_n"))
    ok = F.assert_true(F.col("_n") == rows, F.lit("recent origins are not contiguous")).isNull()
    return lookup_join(kept, counts, keys).filter(ok).drop("_last", "_n")


def coverage(cells: DataFrame, labels: DataFrame, keys: Sequence[str], target: str, horizons: Sequence[int],
             width: int) -> DataFrame:
    """Per fold: validation cells and how many have no label. ``cells``: fold_id, keys, origin."""
    keys = list(keys)
    wide = expand_horizons(cells, horizons).withColumn(
        "interval_start", plus_minutes("origin", F.col("horizon_minutes") - width))
    y = labels.select(*keys, F.col("ts").alias("interval_start"), F.col(target).alias("_y"))
    return join_keys(wide, y, [*keys, "interval_start"], "left").groupBy("fold_id").agg(
        F.count(F.lit(1)).alias("validation_cells"), F.count_if(F.col("_y").isNull()).alias("missing_labels"))


def training_rows(origins: DataFrame, folds: Sequence[Fold], horizons: Sequence[int], sample_minutes: int) -> DataFrame:
    """Upper bound of training cells per fold: mature (origin, horizon) pairs."""
    longest = [plus_minutes("origin", h - sample_minutes) for h in horizons]
    rows = origins.agg(F.array(*[
        F.struct(F.lit(f.fold_id).alias("fold_id"),
                 sum((F.count_if(end <= F.lit(f.train_end).cast("timestamp_ntz")) for end in longest[1:]),
                     F.count_if(longest[0] <= F.lit(f.train_end).cast("timestamp_ntz"))).alias("training_cells"))
        for f in folds]).alias("_a"))
    return rows.select(F.inline("_a"))


def validation_fold(ts: str, folds: Sequence[Fold]) -> Column:
    """Fold whose validation range holds the moment: a literal ladder, no join."""
    out = F.lit(None).cast("string")
    for f in folds:
        inside = F.col(ts).between(F.lit(f.validation_start).cast("timestamp_ntz"),
                                   F.lit(f.validation_end).cast("timestamp_ntz"))
        out = F.when(inside, f.fold_id).otherwise(out)
    return out


def explode_training(df: DataFrame, folds: Sequence[Fold], known_at: Column, out: str = "fold_id") -> DataFrame:
    """One copy of a row per fold that may train on it (expanding window), again without a join."""
    items = F.array(*[F.when(known_at <= F.lit(f.train_end).cast("timestamp_ntz"), F.lit(f.fold_id)) for f in folds])
    return df.select("*", F.explode(F.filter(items, lambda x: x.isNotNull())).alias(out))
