"""Forecast scores pooled over cells, never a mean of means."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegrid.functions.numeric import finite, ratio
from tidegrid.functions.timeline import epoch_minutes
from tidegrid.operators.ordering import quantile_columns, ranking_scores, spearman_pairs, weighted_median
from tidegrid.operators.sizing import join_keys, lookup_join

METRICS = ("mape", "accuracy_1_minus_mape", "mae", "rmse", "valid_count", "zero_actual_count",
           "missing_actual_count", "missing_prediction_count")


def strict_errors(actual: str = "actual", prediction: str = "prediction") -> list[Column]:
    """All four scores over finite, non-zero pairs, with counts of what was left out."""
    a, p = finite(actual), finite(prediction)
    ok = a.isNotNull() & p.isNotNull() & (a != 0)
    e = p - a
    mape = F.avg(F.when(ok, F.abs(e / a)))
    return [mape.alias("mape"), (1.0 - mape).alias("accuracy_1_minus_mape"),
            F.avg(F.when(ok, F.abs(e))).alias("mae"), F.sqrt(F.avg(F.when(ok, e * e))).alias("rmse"),
            F.count_if(F.coalesce(ok, F.lit(False))).alias("valid_count"),
            F.count_if(F.coalesce(a == 0, F.lit(False))).alias("zero_actual_count"),
            F.count_if(a.isNull()).alias("missing_actual_count"),
            F.count_if(p.isNull()).alias("missing_prediction_count")]


def lenient_errors(actual: str = "actual", prediction: str = "prediction") -> list[Column]:
    """MAE and RMSE keep zero actuals; only MAPE drops them."""
    a, p = finite(actual), finite(prediction)
    pair = a.isNotNull() & p.isNotNull()
    e = p - a
    return [F.avg(F.when(pair & (a != 0), F.abs(e / a))).alias("mape"), F.avg(F.when(pair, F.abs(e))).alias("mae"),
            F.sqrt(F.avg(F.when(pair, e * e))).alias("rmse"),
            F.count_if(F.coalesce(pair, F.lit(False))).alias("valid_count"),
            F.count_if(F.coalesce(pair & (a == 0), F.lit(False))).alias("zero_actual_count")]


def rollup(df: DataFrame, views: Mapping[str, Sequence[str]], aggregates: Sequence[Column],
           keep: Mapping[str, Column] | None = None) -> DataFrame:
    """One pass of grouping sets; ``scope`` names the view, absent keys read ``all``.

    ``keep`` restricts a view to some of its groups (such as: no blank episode id).
    """
    columns = list(dict.fromkeys(c for cols in views.values() for c in cols))
    table = df.groupingSets([[F.col(c) for c in cols] for cols in views.values()], *columns).agg(
        F.grouping_id().alias("_gid"), *aggregates)
    gid = {name: sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in cols)
           for name, cols in views.items()}
    scope = reduce(lambda acc, kv: F.when(F.col("_gid") == kv[1], kv[0]).otherwise(acc), gid.items(),
                   F.lit(None).cast("string"))
    table = table.withColumn("scope", scope)
    for name, condition in (keep or {}).items():
        table = table.filter((F.col("scope") != name) | condition)
    bit = lambda c: 1 << (len(columns) - 1 - columns.index(c))
    labels = [F.when(F.col("_gid").bitwiseAND(bit(c)) != 0, F.lit("all"))
              .otherwise(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in columns]
    rest = [c for c in table.columns if c not in (*columns, "_gid", "scope")]
    return table.select("scope", *labels, *rest)


OOF_VIEWS = {"overall": ["model", "period"], "target": ["model", "period", "target"],
             "fold_target": ["model", "period", "fold_id", "target"],
             "target_horizon": ["model", "period", "target", "horizon_minutes"]}

ABLATION_VIEWS = {"overall": ["variant"], "fold": ["variant", "fold_id"],
                  "horizon_bucket": ["variant", "horizon_bucket"], "origin_regime": ["variant", "origin_regime"],
                  "target_event": ["variant", "target_in_event"], "episode": ["variant", "target_episode_id"]}


def summarize_forecasts(df: DataFrame, views: Mapping[str, Sequence[str]] = OOF_VIEWS) -> DataFrame:
    return rollup(df, views, strict_errors())


def summarize_variants(df: DataFrame) -> DataFrame:
    return rollup(df, ABLATION_VIEWS, strict_errors(), {"episode": F.col("target_episode_id") != ""})


def rank_models(df: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    return df.groupBy(*by).agg(*strict_errors()).orderBy(F.col("mape").asc_nulls_last(), *by)


def weighted_gain(pairs: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    """Weighted MAPE of control and candidate on the same cells, and the gain in points."""
    ok = (F.col("actual") != 0) & F.col("control").isNotNull() & F.col("candidate").isNotNull()
    ape = lambda c: F.abs(ratio(F.col(c) - F.col("actual"), F.col("actual")))
    w = F.when(ok, F.col(weight))
    score = lambda c: ratio(F.sum(w * ape(c)), F.sum(w))
    return pairs.groupBy(*keys).agg(
        score("control").alias("control_mape"), score("candidate").alias("candidate_mape"),
        ((score("control") - score("candidate")) * 100.0).alias("accuracy_gain_pct"))


def effective_size(df: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    """Kish effective sample size and the top-quartile threshold of the weights."""
    w = F.col(weight)
    sizes = df.groupBy(*keys).agg(ratio(F.sum(w) * F.sum(w), F.sum(w * w)).alias("effective_sample_size"),
                                  F.count(w).alias("row_count"))
    cut = quantile_columns(df, keys, weight, {"top_quartile_threshold": 0.75}).drop("n_values")
    return join_keys(sizes, cut, list(keys))


def top_share_flag(df: DataFrame, keys: Sequence[str], score: str, share: float, out: str) -> DataFrame:
    cut = quantile_columns(df, keys, score, {"_cut": 1.0 - share}).drop("n_values")
    return lookup_join(df, cut, keys).withColumn(
        out, (F.col(score) >= F.col("_cut")).cast("int")).drop("_cut")


def scan_weights(pairs: DataFrame, keys: Sequence[str], weights: Sequence[float], combine) -> DataFrame:
    """Best literal weight per group; every weight is one aggregate of the same pass, no row copies.

    ``combine(w)`` gives the prediction column for a weight.
    """
    ok = F.col("actual").isNotNull() & (F.col("actual") != 0)
    score = lambda w: F.avg(F.when(ok, F.abs((combine(w) - F.col("actual")) / F.col("actual"))))
    table = pairs.groupBy(*keys).agg(
        F.array(*[F.struct(score(w).alias("mape"), F.lit(float(w)).alias("weight")) for w in weights]).alias("_s"))
    best = F.array_min(F.filter("_s", lambda s: s["mape"].isNotNull()))
    return table.select(*keys, best["weight"].alias("best_weight"), best["mape"].alias("best_mape"))


def optimal_scale(df: DataFrame, keys: Sequence[str], actual: str, prediction: str, out: str) -> DataFrame:
    """Scale minimising MAPE: median of actual/prediction weighted by prediction/actual."""
    a, p = F.col(actual), F.col(prediction)
    ready = df.filter((a > 0) & (p > 0)).select(*keys, (a / p).alias("_ratio"), (p / a).alias("_weight"))
    return weighted_median(ready, keys, "_ratio", "_weight", out)


def floor_mape(actual: str, prediction: str, floor: float) -> Column:
    a = F.col(actual)
    return F.avg(F.when(F.abs(a) > floor, F.abs((F.col(prediction) - a) / a)))


def signed_bias(actual: str = "actual", prediction: str = "prediction") -> list[Column]:
    a, p = F.col(actual), F.col(prediction)
    both = a.isNotNull() & p.isNotNull()
    ma, mp = F.avg(F.when(both, a)), F.avg(F.when(both, p))
    return [F.avg(p - a).alias("bias"), F.when(ma != 0, mp / ma).alias("mean_ratio")]


def horizon_monotonicity(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How often the error falls from one horizon to the next (a table of at most one row per horizon)."""
    w = Window.partitionBy(*keys).orderBy("horizon_minutes")
    return (table.withColumn("_before", F.lag("mape").over(w)).groupBy(*keys)
            .agg(F.count_if(F.col("mape") < F.col("_before")).alias("violations"),
                 F.count(F.lit(1)).alias("horizons")))


def binary_scores(df: DataFrame, keys: Sequence[str], probability: str, label: str, alert: str) -> DataFrame:
    """Average precision and lift, ROC-AUC, Brier score, precision and recall of the alert flag."""
    keys = list(keys)
    p, y, a = F.col(probability), F.col(label).cast("int"), F.col(alert).cast("int")
    base = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(y).alias("positive_rows"), F.avg((p - y) * (p - y)).alias("brier"),
        F.avg(a.cast("double")).alias("alert_rate"),
        F.when(F.sum(a) > 0, F.sum(a * y) / F.sum(a)).alias("alert_precision"),
        F.when(F.sum(y) > 0, F.sum(a * y) / F.sum(y)).alias("alert_recall"))
    ranked = ranking_scores(df, keys, probability, label).drop("positives", "negatives")
    return (join_keys(base, ranked, keys, "left")
            .withColumn("average_precision_lift", F.when(F.col("prevalence") > 0,
                                                         F.col("average_precision") / F.col("prevalence"))))


def alert_thresholds(df: DataFrame, keys: Sequence[str], probability: str, budget: float) -> DataFrame:
    if not 0 < budget < 1:
        raise ValueError("budget must lie between zero and one")
    return quantile_columns(df, keys, probability, {"alert_threshold": 1.0 - budget}).drop("n_values")


def residuals_by_origin(df: DataFrame, keys: Sequence[str], bucket: str, near: str, far: str) -> DataFrame:
    """Mean signed percentage residual and mean actual of a near and a far bucket per origin."""
    ok = df.filter((F.col("actual") != 0) & F.col("prediction").isNotNull())
    signed = (F.col("actual") - F.col("prediction")) / F.abs("actual")
    table = (ok.groupBy(*keys).pivot(bucket, [near, far])
             .agg(F.avg(signed).alias("residual"), F.avg("actual").alias("level")))
    out = table.select(*keys, F.col(f"`{near}_residual`").alias("near_signed_percentage_residual"),
                       F.col(f"`{far}_residual`").alias("far_signed_percentage_residual"),
                       F.col(f"`{near}_level`").alias("near_actual_mean"),
                       F.col(f"`{far}_level`").alias("far_actual_mean"))
    change = F.col("far_actual_mean") - F.col("near_actual_mean")
    floor = F.when(F.col("near_actual_mean").isNotNull(), F.greatest(F.abs("near_actual_mean"), F.lit(1e-6)))
    return out.withColumn("far_minus_near_actual_ratio", change / floor)


def pressure_relation(per_origin: DataFrame, block: str, score: str, residual: str, change: str) -> DataFrame:
    """Score-to-residual relation, pooled and per block."""
    scoped = per_origin.select("*", F.explode(F.array(F.lit("pooled"), F.col(block))).alias("scope"))
    high, low = F.col("score_group") == "high", F.col("score_group") == "low"
    frac = lambda c: F.avg(c.cast("double"))
    spread = (F.avg(F.when(high, F.col(residual))) - F.avg(F.when(low, F.col(residual)))) * 100.0
    base = scoped.groupBy("scope").agg(
        F.count(F.lit(1)).alias("origin_count"), frac(high).alias("high_score_fraction"),
        frac(low).alias("low_score_fraction"),
        frac((F.col("high_zone") == 1) | (F.col("low_zone") == 1)).alias("boundary_zone_fraction"),
        spread.alias("high_minus_low_far_residual_pct"))
    named = {"pressure_residual_spearman": (score, residual), "pressure_target_change_spearman": (score, change)}
    rho = spearman_pairs(scoped, ["scope"], list(named.values()))
    wide = rho.groupBy("scope").agg(*[F.max(F.when(F.col("pair") == i, F.col("rho"))).alias(n) for i, n in enumerate(named)])
    return join_keys(base, wide, ["scope"], "left")


def trajectory_shape(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Disagreement of two forecast trajectories per origin, their slopes and which one won."""
    d = F.col("candidate") - F.col("control")
    ape = lambda c: F.avg(F.abs((F.col(c) - F.col("actual")) / F.col("actual")))
    slope = lambda c: F.max_by(c, "horizon_minutes") - F.min_by(c, "horizon_minutes")
    return pairs.filter(F.col("actual") != 0).groupBy(*keys).agg(
        F.avg(d).alias("mean_disagreement"), F.avg(F.abs(d)).alias("mean_absolute_disagreement"),
        F.stddev_pop(d).alias("disagreement_std"), F.min(d).alias("minimum_disagreement"),
        F.max(d).alias("maximum_disagreement"), slope("control").alias("control_slope"),
        slope("candidate").alias("candidate_slope"), ape("control").alias("control_ape"),
        ape("candidate").alias("candidate_ape"),
        (ape("candidate") < ape("control")).cast("int").alias("candidate_wins"))


def daily_levels(df: DataFrame, keys: Sequence[str], ts: str, value: str, out: str) -> DataFrame:
    return df.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.avg(value).alias(out))


def pair_variants(df: DataFrame, keys: Sequence[str], control: str, candidate: str, column: str = "model") -> DataFrame:
    """Control and candidate of the same cell side by side, by one pivot-like aggregate (no self join)."""
    pick = lambda v: F.max(F.when(F.col(column) == v, F.col("prediction")))
    return (df.filter(F.col(column).isin(control, candidate)).groupBy(*keys)
            .agg(F.max("actual").alias("actual"), pick(control).alias("control"), pick(candidate).alias("candidate"),
                 F.count(F.lit(1)).alias("_rows"), F.min("actual").alias("_low"))
            .withColumn("paired", (F.col("_rows") == 2) & F.col("control").isNotNull() & F.col("candidate").isNotNull()
                        & (F.col("actual").eqNullSafe(F.col("_low")))).drop("_rows", "_low"))


def minutes_apart(a: str, b: str) -> Column:
    return epoch_minutes(a) - epoch_minutes(b)
