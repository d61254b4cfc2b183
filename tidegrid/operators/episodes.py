"""Threshold days, episodes and their outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tidegrid.operators.ordering import prefix_sums, quantile_columns, rank_auc
from tidegrid.operators.sizing import join_keys, keyed_join


def event_days(df: DataFrame, keys: Sequence[str], ts: str, ratio: str, threshold: float) -> DataFrame:
    """Calendar days of a series holding a below-threshold ratio."""
    keys = list(keys)
    days = (df.filter(F.col(ratio) < threshold).groupBy(*keys, F.to_date(ts).alias("event_date"))
            .agg(F.min(ts).alias("first_flag"), F.max(ts).alias("last_flag"),
                 F.count(F.lit(1)).alias("flagged_points"), F.min(ratio).alias("min_ratio")))
    # One row per calendar day and series: the frame is bounded by the days on record.
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("event_date"))
    return days.withColumn("event_day_id", F.concat_ws("_", *keys, F.lit("day"), F.lpad(number.cast("string"), 2, "0")))


def merge_days(days: DataFrame, keys: Sequence[str], gap_days: int = 1) -> DataFrame:
    """Gaps and islands: days at most ``gap_days`` apart form one episode."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("event_date")
    gap = F.datediff("event_date", F.lag("event_date").over(w))
    marked = days.withColumn("_new", F.when(gap <= gap_days, 0).otherwise(1))
    marked = marked.withColumn("episode_number", F.sum("_new").over(w))
    members = F.transform(F.sort_array(F.collect_list(F.struct("event_date", "event_day_id"))),
                          lambda s: s["event_day_id"])
    return (marked.groupBy(*keys, "episode_number")
            .agg(F.min("event_date").alias("first_event_date"), F.max("event_date").alias("last_event_date"),
                 F.min("first_flag").alias("episode_start"), F.max("last_flag").alias("episode_end"),
                 F.count(F.lit(1)).alias("event_day_count"), F.sum("flagged_points").alias("flagged_points"),
                 F.min("min_ratio").alias("min_ratio"), F.array_join(members, "|").alias("member_event_day_ids"))
            .withColumn("episode_id", F.concat_ws(
                "_", *keys, F.lit("episode"), F.lpad(F.col("episode_number").cast("string"), 2, "0"))))


def outcome_classes(table: DataFrame, threshold: float, hours: Sequence[int] = (2, 6, 12, 24)) -> DataFrame:
    """Drop flags after each reach and the sustained and rebound classes built from them."""
    first, second, third, last = hours
    flag = lambda h: F.coalesce(F.col(f"future_{h}h_mean_change") <= threshold, F.lit(False))
    out = table.select("*", *[flag(h).alias(f"drop_{h}h") for h in hours])
    back = F.coalesce(F.col(f"future_{last}h_mean_change") > 0, F.lit(False))
    return out.withColumns({
        f"sustained_drop_{second}h": F.col(f"drop_{first}h") & F.col(f"drop_{second}h"),
        f"sustained_drop_{third}h": F.col(f"drop_{first}h") & F.col(f"drop_{second}h") & F.col(f"drop_{third}h"),
        f"rebound_by_{last}h": F.col(f"drop_{first}h") & back})


def precursor_scores(pairs: DataFrame, keys: Sequence[str], feature: str, event_value: str,
                     control_value: str) -> DataFrame:
    """Robust z-score of each event origin against its matched controls.

    A group holds at most the declared number of controls, so built-in percentiles are safe.
    """
    keys = list(keys)
    value = F.col(control_value)
    base = pairs.groupBy(*keys, feature).agg(
        F.first(event_value).alias("event_value"), F.percentile(value, F.lit(0.5)).alias("control_median"),
        F.stddev_pop(value).alias("_std"), F.count(F.lit(1)).alias("control_count"),
        F.collect_list(value).alias("_controls"))
    spread = F.transform("_controls", lambda v: F.abs(v - F.col("control_median")))
    middle = lambda a: (F.element_at(a, F.floor((F.size(a) + 1) / 2).cast("int"))
                        + F.element_at(a, F.ceil((F.size(a) + 1) / 2).cast("int"))) / 2.0
    base = base.withColumn("_mad", F.when(F.size("_controls") > 0, middle(F.sort_array(spread))))
    scale = F.when(F.col("_mad") * 1.4826 > 1e-12, F.col("_mad") * 1.4826).otherwise(F.col("_std"))
    difference = F.col("event_value") - F.col("control_median")
    z = F.when(scale != 0, F.greatest(F.lit(-10.0), F.least(F.lit(10.0), difference / scale)))
    return (base.filter(F.col("event_value").isNotNull() & F.col("control_median").isNotNull())
            .select(*keys, feature, "event_value", "control_median", difference.alias("paired_difference"),
                    scale.alias("control_scale"), z.alias("standardized_difference"), "control_count"))


def precursor_summary(per_event: DataFrame, groups: Sequence[str], unit: str) -> DataFrame:
    """Median z, direction consistency and effect score per (lead, feature)."""
    groups = list(groups)
    positive = F.avg(F.when(F.col("paired_difference").isNotNull(), (F.col("paired_difference") > 0).cast("double")))
    medians = {"event_value": "median_event_value", "control_median": "median_control_value",
               "paired_difference": "median_paired_difference", "standardized_difference": "median_standardized_difference"}
    cells = per_event.unpivot(groups, list(medians), "_measure", "_value")
    mid = quantile_columns(cells, [*groups, "_measure"], "_value", {"_m": 0.5})
    wide = mid.groupBy(*groups).agg(*[F.max(F.when(F.col("_measure") == m, F.col("_m"))).alias(n) for m, n in medians.items()])
    table = per_event.groupBy(*groups).agg(F.count_distinct(unit).alias("event_samples"), positive.alias("positive_fraction"))
    table = join_keys(table, wide, groups, "left")
    consistency = F.greatest(F.col("positive_fraction"), 1.0 - F.col("positive_fraction"))
    return table.withColumn("direction_consistency", consistency).withColumn(
        "effect_score", F.abs("median_standardized_difference") * F.col("direction_consistency"))


def leave_one_out_accuracy(df: DataFrame, keys: Sequence[str], value: str, label: str, out: str) -> DataFrame:
    """Balanced accuracy of the midpoint-of-medians threshold, each row judged by the others.

    Removing one value shifts its class median by at most one rank, so the three middle order
    statistics of each class are enough: linear work, no self join.
    """
    keys = list(keys)
    rows = (df.filter(F.col(value).isNotNull() & F.col(label).isNotNull())
            .select(*keys, F.col(label).cast("int").alias("_y"), F.col(value).cast("double").alias("_v"),
                    F.lit(1).alias("n")))
    table = prefix_sums(rows, [*keys, "_y"], "_v", ["n"])
    size, below, count = F.col("n_total"), F.col("n_below"), F.col("n")
    at = lambda spot: F.max(F.when((below <= spot) & (spot < below + count), F.col("_v")))
    half = F.floor(size / 2)
    middle = table.groupBy(*keys, "_y").agg(
        F.max("n_total").alias("_n"), at(half - 1).alias("_a"), at(half).alias("_b"), at(half + 1).alias("_c"))
    n, a, b, c = (F.col(x) for x in ("_n", "_a", "_b", "_c"))
    full = F.when(n % 2 == 1, b).otherwise((a + b) / 2)
    sides = middle.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_y") == y, e)).alias(f"_{name}{y}") for y in (0, 1)
          for name, e in (("full", full), ("n", n), ("a", a), ("b", b), ("c", c))])
    joined = keyed_join(table, sides, keys)
    own = lambda name: F.when(F.col("_y") == 1, F.col(f"_{name}1")).otherwise(F.col(f"_{name}0"))
    # Ranks k of equal values give the same reduced median; use the first.
    k, m = below, own("n")
    h = F.floor(m / 2)
    odd = F.when(k < h, (own("b") + own("c")) / 2).when(k == h, (own("a") + own("c")) / 2).otherwise(
        (own("a") + own("b")) / 2)
    even = F.when(k <= h - 1, own("b")).otherwise(own("a"))
    reduced = F.when(m > 1, F.when(m % 2 == 1, odd).otherwise(even))
    pos = F.when(F.col("_y") == 1, reduced).otherwise(F.col("_full1"))
    neg = F.when(F.col("_y") == 0, reduced).otherwise(F.col("_full0"))
    scored = joined.withColumn("_p", pos).withColumn("_q", neg).filter("_p IS NOT NULL AND _q IS NOT NULL")
    cut = (F.col("_p") + F.col("_q")) / 2
    said = F.when(F.col("_p") >= F.col("_q"), F.col("_v") >= cut).otherwise(F.col("_v") <= cut)
    right = (said == (F.col("_y") == 1)).cast("int")
    share = lambda y: F.sum(F.when(F.col("_y") == y, right * count)) / F.sum(F.when(F.col("_y") == y, count))
    rates = scored.groupBy(*keys).agg(share(1).alias("_tpr"), share(0).alias("_tnr"))
    both = F.when(F.col("_tpr").isNull(), F.col("_tnr")).when(F.col("_tnr").isNull(), F.col("_tpr")).otherwise(
        (F.col("_tpr") + F.col("_tnr")) / 2)
    return rates.select(*keys, both.alias(out))


def outcome_discrimination(per_event: DataFrame, outcomes: DataFrame, on: Sequence[str], groups: Sequence[str],
                           outcome: str, value: str, unit: str) -> DataFrame:
    """AUC, leave-one-out accuracy and screening score of every (lead, feature)."""
    merged = join_keys(per_event, outcomes.select(*on, outcome), list(on))
    y = F.col(outcome).cast("boolean")
    base = merged.groupBy(*groups).agg(
        F.count_distinct(unit).alias("event_samples"), F.count_if(y).alias("positive_events"),
        F.count_if(~y).alias("negative_events"))
    mid = quantile_columns(merged.withColumn("_y", y), [*groups, "_y"], value, {"_m": 0.5}).groupBy(*groups).agg(
        F.max(F.when(F.col("_y"), F.col("_m"))).alias("positive_median_z"),
        F.max(F.when(~F.col("_y"), F.col("_m"))).alias("negative_median_z"))
    auc = rank_auc(merged, groups, value, outcome, "rank_auc").drop("positives", "negatives")
    loo = leave_one_out_accuracy(merged, groups, value, outcome, "loo_threshold_balanced_accuracy")
    separation = F.abs(F.col("rank_auc") - 0.5) * 2
    return (join_keys(join_keys(join_keys(base, mid, list(groups), "left"), auc, list(groups), "left"), loo, list(groups), "left")
            .withColumn("rank_separation", separation)
            .withColumn("screening_score", separation * F.col("loo_threshold_balanced_accuracy")))
