"""Declarative promotion gates over metric tables and audit rules over findings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidegrid.operators.sizing import join_keys


@dataclass(frozen=True)
class Check:
    """``column`` compared with a literal bound; a missing value fails unless ``null_passes``."""

    name: str
    column: str
    op: str
    bound: float
    null_passes: bool = False

    def expr(self) -> Column:
        c, b = F.col(self.column), F.lit(self.bound)
        test = {">=": c >= b, "<=": c <= b, ">": c > b, "<": c < b}[self.op]
        return F.coalesce(test, F.lit(self.null_passes))


def apply_checks(df: DataFrame, checks: Sequence[Check], verdict: str = "gate_passed") -> DataFrame:
    flags = [c.expr().alias(c.name) for c in checks]
    out = df.select("*", *flags)
    return out.withColumn(verdict, reduce(lambda a, b: a & b, [F.col(c.name) for c in checks]))


def gains_against(metrics: DataFrame, control: str, buckets: Sequence[str], recent_folds: Sequence[str]) -> DataFrame:
    """Accuracy gains of every candidate over the control, one row per candidate.

    The metric table has a handful of rows per variant; each candidate row meets the control row of
    the same scope by an equi-join, then one conditional aggregate lays the gains side by side.
    """
    scope_keys = ["scope", "fold_id", "horizon_bucket", "origin_regime", "target_in_event", "target_episode_id"]
    acc = F.col("accuracy_1_minus_mape")
    base = metrics.filter(F.col("variant") == control).select(*scope_keys, acc.alias("_control"))
    cand = metrics.filter(F.col("variant") != control).select("variant", *scope_keys, acc.alias("_candidate"))
    gain = (F.col("_candidate") - F.col("_control")) * 100.0
    joined = join_keys(cand, base, scope_keys, "left").withColumn("_gain", gain)
    at = lambda scope, test=F.lit(True): F.max(F.when((F.col("scope") == scope) & test, F.col("_gain")))
    recent = (F.col("scope") == "fold") & F.col("fold_id").isin(list(recent_folds))
    episode = (F.col("scope") == "episode") & F.col("_control").isNotNull()
    better = (F.col("_candidate") > F.col("_control")).cast("double")
    aggs = [at("overall").alias("overall_accuracy_gain_pct"),
            (-at("origin_regime", F.col("origin_regime") == "ordinary")).alias("ordinary_accuracy_loss_pct"),
            F.avg(F.when(recent, F.col("_gain"))).alias("recent_fold_mean_gain_pct"),
            F.avg(F.when(episode, better)).alias("episode_improvement_fraction"),
            F.count_if(episode).alias("evaluated_episode_count")]
    aggs += [at("horizon_bucket", F.col("horizon_bucket") == b).alias(f"{b}_gain_pct") for b in buckets]
    table = joined.groupBy("variant").agg(*aggs)
    return table.withColumn("near_far_minimum_pct", F.least(F.col(f"{buckets[0]}_gain_pct"),
                                                            F.col(f"{buckets[-1]}_gain_pct")))


def promotion_gate(metrics: DataFrame, control: str, buckets: Sequence[str], recent_folds: Sequence[str], *,
                   min_gain: float, max_ordinary_loss: float, require_recent: bool = True,
                   require_episodes: bool = True, require_near_far: bool = True) -> DataFrame:
    checks = [Check("pass_overall", "overall_accuracy_gain_pct", ">=", min_gain),
              Check("pass_ordinary", "ordinary_accuracy_loss_pct", "<=", max_ordinary_loss)]
    if require_recent:
        checks.append(Check("pass_recent", "recent_fold_mean_gain_pct", ">=", 0.0))
    if require_episodes:
        checks.append(Check("pass_episodes", "episode_improvement_fraction", ">", 0.5))
    if require_near_far:
        checks.append(Check("pass_near_far", "near_far_minimum_pct", ">=", -max_ordinary_loss))
    return apply_checks(gains_against(metrics, control, buckets, recent_folds), checks, "promotion_gate_passed")


def inverse_gate(summary: DataFrame, *, max_rho: float, max_positive_blocks: float, max_spread: float,
                 max_change: float, min_extreme: float) -> DataFrame:
    """All-upper-bound gate on a pressure relation table (one pooled row, one row per block)."""
    pooled, block = F.col("scope") == "pooled", F.col("scope") != "pooled"
    top = lambda c: F.max(F.when(pooled, F.col(c)))
    share = lambda c: F.avg(F.when(block, F.coalesce(F.col(c) < 0, F.lit(False)).cast("double")))
    row = summary.agg(
        top("pressure_residual_spearman").alias("pooled_far_residual_spearman"),
        share("pressure_residual_spearman").alias("negative_rho_block_fraction"),
        top("high_minus_low_far_residual_pct").alias("pooled_high_low_far_residual_spread_pct"),
        share("high_minus_low_far_residual_pct").alias("negative_spread_block_fraction"),
        top("pressure_target_change_spearman").alias("pooled_target_change_spearman"),
        share("pressure_target_change_spearman").alias("negative_change_block_fraction"),
        F.min(F.when(block, F.least("high_score_fraction", "low_score_fraction"))).alias("minimum_extreme_group_fraction"))
    need = 1.0 - max_positive_blocks
    return apply_checks(row, [
        Check("pass_pooled_rho", "pooled_far_residual_spearman", "<=", max_rho),
        Check("pass_block_direction", "negative_rho_block_fraction", ">=", need),
        Check("pass_pooled_spread", "pooled_high_low_far_residual_spread_pct", "<=", max_spread),
        Check("pass_spread_blocks", "negative_spread_block_fraction", ">=", need),
        Check("pass_target_change", "pooled_target_change_spearman", "<=", max_change),
        Check("pass_change_blocks", "negative_change_block_fraction", ">=", need),
        Check("pass_coverage", "minimum_extreme_group_fraction", ">=", min_extreme)], "gate_passed")


def findings(rows: DataFrame, rules: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """One finding per (row, broken rule). ``rules`` maps a code to (severity, condition)."""
    items = F.array(*[F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity")))
                      for code, (sev, cond) in rules.items()])
    return rows.select("*", F.explode(F.filter(items, lambda i: i.isNotNull())).alias("_f")).select(
        *rows.columns, "_f.code", "_f.severity")


def overall_status(found: DataFrame) -> DataFrame:
    """Worst severity and how many findings of each kind."""
    rank = F.when(F.col("severity") == "error", 2).when(F.col("severity") == "warning", 1).otherwise(0)
    worst = F.coalesce(F.max_by("severity", rank), F.lit("ok"))
    return found.agg(worst.alias("status"), F.count_if(F.col("severity") == "error").alias("errors"),
                     F.count_if(F.col("severity") == "warning").alias("warnings"),
                     F.count_if(F.col("severity") == "info").alias("infos"))
