"""Column profiles, outlier fences, duplicate and time-grid audits, drift."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tidegrid.functions.numeric import ratio
from tidegrid.functions.timeline import epoch_minutes, from_epoch_minutes
from tidegrid.operators.chunks import adjacent
from tidegrid.operators.ordering import quantile_columns
from tidegrid.operators.sizing import join_keys, lookup_join
from tidegrid.session import cut


def long_cells(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "column_name",
               value: str = "value") -> DataFrame:
    """Wide signals to (column, value) cells as doubles; a narrow expansion."""
    cast = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns])
    return cast.unpivot(list(ids), list(columns), name, value)


def column_profile(df: DataFrame, ts: str, columns: Sequence[str], huge: float = 1e9) -> DataFrame:
    """Counts, extremes, first/last valid time, exact distincts and quantiles of every column."""
    cells = long_cells(df, [ts], columns)
    v = F.col("value")
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    base = cells.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(v.isNull()).alias("null_count"),
        F.count_if(v == 0).alias("zero_count"), F.count_if(v < 0).alias("negative_count"),
        F.count_if(F.coalesce(F.abs(v) == float("inf"), F.lit(False))).alias("infinite_count"),
        F.count_if(F.abs(v) > huge).alias("huge_count"), F.min(F.when(ok, v)).alias("minimum"),
        F.max(F.when(ok, v)).alias("maximum"), F.min(F.when(ok, F.col(ts))).alias("first_valid"),
        F.max(F.when(ok, F.col(ts))).alias("last_valid"))
    # Two-step exact distinct: equal values collapse on the map side and hash over all tasks.
    distinct = (cells.filter(ok).groupBy("column_name", "value").agg(F.lit(1).alias("_one"))
                .groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct_count")))
    named = {"q01": 0.01, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q99": 0.99}
    quant = quantile_columns(cells.filter(ok), ["column_name"], "value", named).drop("n_values")
    out = join_keys(join_keys(base, distinct, ["column_name"], "left"), quant, ["column_name"], "left")
    count = F.coalesce("distinct_count", F.lit(0))
    return out.withColumns({"distinct_count": count, "all_empty": F.col("null_count") == F.col("row_count"),
                            "is_constant": (count + (F.col("null_count") > 0).cast("int")) <= 1})


def drop_empty_columns(df: DataFrame, declared: Sequence[str]) -> DataFrame:
    """Without the columns declared empty; a value in one of them fails."""
    held = df.agg(*[F.count(c).alias(c) for c in declared]).first()
    full = [c for c in declared if held[c]]
    if full:
        raise ValueError(f"declared empty but not: {full}")
    return df.drop(*declared)


def constant_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column with its level count, NULL counted as a level; no distinct set is kept.

    A column is constant exactly when min equals max and NULL does not mix with values.
    """
    aggs = [F.struct(F.lit(c).alias("column_name"),
                     ((F.count(c) == 0) | ((F.min(c) == F.max(c)) & (F.count(c) == F.count(F.lit(1)))))
                     .alias("is_constant")) for c in columns]
    return df.agg(F.array(*aggs).alias("_a")).select(F.inline("_a"))


def outlier_candidates(df: DataFrame, keys: Sequence[str], value: str, *, fence: float = 1.5, z_limit: float = 6.0,
                       consistency: float = 1.4826) -> DataFrame:
    """Values outside the quartile fence, and values with a robust z above the limit (none if MAD is 0)."""
    keys = list(keys)
    q = quantile_columns(df, keys, value, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    joined = lookup_join(df.select(*keys, F.col(value).cast("double").alias("_v")), q, keys)
    joined = joined.withColumn("_d", F.abs(F.col("_v") - F.col("q50")))
    mad = quantile_columns(joined, keys, "_d", {"mad": 0.5}).drop("n_values")
    iqr = F.col("q75") - F.col("q25")
    both = lookup_join(joined, mad, keys)
    outside = (F.col("_v") < F.col("q25") - fence * iqr) | (F.col("_v") > F.col("q75") + fence * iqr)
    far = F.coalesce(ratio(F.col("_d"), F.col("mad") * consistency) > z_limit, F.lit(False))
    return both.groupBy(*keys, "q25", "q50", "q75", "mad").agg(
        F.count("_v").alias("value_count"), F.count_if(outside).alias("fence_count"), F.count_if(far).alias("robust_z_count"))


def duplicate_summary(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows in repeated keys and in repeated full rows, every member counted."""
    repeated = lambda cols: (df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
                             .agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_rows")))
    a = repeated(list(keys)).select(F.lit("key").alias("kind"), F.col("_rows").alias("duplicate_rows"))
    b = repeated(df.columns).select(F.lit("full_row").alias("kind"), F.col("_rows").alias("duplicate_rows"))
    return a.unionByName(b)


def time_steps(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Minutes to the previous distinct moment of the series; bridged across chunks."""
    moments = df.select(*keys, ts).distinct()
    return adjacent(moments, keys, ts, "previous_ts").withColumn(
        "step_minutes", epoch_minutes(ts) - epoch_minutes("previous_ts"))


def grid_audit(df: DataFrame, keys: Sequence[str], ts: str, shown: int = 20) -> DataFrame:
    """Modal step (smallest on ties), rows off the step, gaps, missing points and the first few of them."""
    keys = list(keys)
    steps = cut(time_steps(df, keys, ts))
    counts = steps.filter("step_minutes IS NOT NULL").groupBy(*keys, "step_minutes").agg(F.count(F.lit(1)).alias("_n"))
    modal = counts.groupBy(*keys).agg(F.max_by("step_minutes", F.struct("_n", -F.col("step_minutes")))
                                      .alias("modal_step"))
    joined = lookup_join(steps, modal, keys)
    gap = F.col("step_minutes") > F.col("modal_step")
    missing = F.when(gap, F.ceil(F.col("step_minutes") / F.col("modal_step")) - 1).otherwise(0)
    base = joined.groupBy(*keys, "modal_step").agg(
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("distinct_moments"),
        F.count_if(F.col("step_minutes") != F.col("modal_step")).alias("off_step_count"),
        F.count_if(gap).alias("gap_count"), F.sum(missing).alias("missing_points"))
    # The first gaps hold the first missing points: rank gaps, expand only those that can be shown.
    gaps = joined.filter(gap).withColumn("_first", epoch_minutes("previous_ts") + F.col("modal_step"))
    ranked = gaps.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("_first"))).filter(
        F.col("_k") <= shown)
    last = F.least(epoch_minutes(ts) - 1, F.col("_first") + F.col("modal_step") * (shown - 1))
    points = ranked.select(*keys, F.explode(F.sequence(F.col("_first"), last, F.col("modal_step"))).alias("_m"))
    head = points.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list("_m")), 1, shown).alias("_list"))
    text = F.array_join(F.transform("_list", lambda m: F.date_format(from_epoch_minutes(m), "yyyy-MM-dd HH:mm")), "|")
    return join_keys(base, head.select(*keys, text.alias("first_missing")), keys, "left")


def table_presence(tables: Mapping[str, DataFrame], key: str) -> DataFrame:
    """One row per distinct key with a 0/1 flag per table; the flags are bounded by the table count."""
    parts = [df.select(key).distinct().select(key, F.lit(name).alias("_t")) for name, df in tables.items()]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy(key).agg(*[F.max((F.col("_t") == n).cast("int")).alias(n) for n in tables])


def table_alignment(tables: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Union, intersection, exclusive and pairwise overlap counts in one aggregate."""
    names = list(tables)
    presence = table_presence(tables, key)
    held = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    items = [("union", F.lit(True)), ("intersection", held == len(names))]
    items += [(f"only:{n}", (F.col(n) == 1) & (held == 1)) for n in names]
    items += [(f"pair:{a}+{b}", (F.col(a) == 1) & (F.col(b) == 1)) for i, a in enumerate(names) for b in names[i + 1:]]
    row = presence.agg(F.array(*[F.struct(F.lit(n).alias("measure"), F.count_if(c).alias("moments"))
                                 for n, c in items]).alias("_a"))
    return row.select(F.inline("_a"))


def mean_shift(train_tail: DataFrame, test: DataFrame, columns: Sequence[str], minimum: int = 100) -> DataFrame:
    """Standardised change of the column mean; needs enough values on both sides."""
    side = lambda df, name: long_cells(df, [], columns).withColumn("_side", F.lit(name))
    cells = side(train_tail, "train").unionByName(side(test, "test"))
    v = lambda s: F.when(F.col("_side") == s, F.col("value"))
    table = cells.groupBy("column_name").agg(
        F.count(v("train")).alias("train_count"), F.count(v("test")).alias("test_count"),
        F.avg(v("train")).alias("train_mean"), F.avg(v("test")).alias("test_mean"),
        F.stddev_samp(v("train")).alias("train_std"))
    enough = (F.col("train_count") >= minimum) & (F.col("test_count") >= minimum) & (F.col("train_std") > 0)
    return table.withColumn("standardized_mean_shift",
                            F.when(enough, (F.col("test_mean") - F.col("train_mean")) / F.col("train_std")))


def support_shift(train: DataFrame, reference: DataFrame, test: DataFrame, columns: Sequence[str],
                  low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Median shift in reference IQRs and the share of test values outside the train support.

    The three periods are one labelled table, so all quantiles and extremes come from one call.
    """
    side = lambda d, name: long_cells(d, [], columns).withColumn("side", F.lit(name))
    cells = side(train, "train").unionByName(side(reference, "reference")).unionByName(side(test, "test"))
    named = {"lowest": 0.0, "soft_low": low, "q25": 0.25, "median": 0.5, "q75": 0.75, "soft_high": high, "highest": 1.0}
    q = cut(quantile_columns(cells, ["side", "column_name"], "value", named))
    at = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    wide = q.groupBy("column_name").agg(
        at("train", "n_values").alias("train_n"), at("reference", "n_values").alias("reference_n"),
        at("train", "median").alias("train_median"), at("reference", "median").alias("reference_median"),
        at("test", "median").alias("test_median"), (at("reference", "q75") - at("reference", "q25")).alias("reference_iqr"),
        at("train", "soft_low").alias("soft_support_low"), at("train", "soft_high").alias("soft_support_high"),
        at("train", "lowest").alias("_min"), at("train", "highest").alias("_max"))
    v = F.col("value")
    share = lambda c: F.avg(F.when(v.isNotNull(), c.cast("double")))
    tested = lookup_join(side(test, "test"), wide, ["column_name"])
    rates = tested.groupBy(*wide.columns).agg(
        F.count("value").alias("test_n"), (1.0 - F.count("value") / F.count(F.lit(1))).alias("test_missing_rate"),
        share(v < F.col("soft_support_low")).alias("out_of_support_below_rate"),
        share(v > F.col("soft_support_high")).alias("out_of_support_above_rate"),
        share(v < F.col("_min")).alias("hard_below_rate"), share(v > F.col("_max")).alias("hard_above_rate"))
    shift = (F.col("test_median") - F.col("reference_median")) / F.col("reference_iqr")
    return rates.drop("_min", "_max").withColumns({
        "out_of_support_rate": F.col("out_of_support_below_rate") + F.col("out_of_support_above_rate"),
        "hard_out_of_range_rate": F.col("hard_below_rate") + F.col("hard_above_rate"),
        "median_shift_in_reference_iqr": F.when(F.col("reference_iqr") > 0, shift)})
