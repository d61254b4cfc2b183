"""Forecast arithmetic: projections, caps, blends, gates and sample weights."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidegrid.functions.numeric import clip, ratio
from tidegrid.operators.sizing import lookup_join


def project_bounds(part: Column, total: Column, part_max: float, total_max: float, *,
                   repair: str = "lower_part") -> dict[str, Column]:
    """Clip both targets to ``[0, max]`` and restore ``part <= total``.

    ``repair`` says which side moves: ``lower_part`` or ``raise_total``.
    """
    p, t = clip(part, 0.0, part_max), clip(total, 0.0, total_max)
    if repair == "lower_part":
        return {"part": F.when(p.isNotNull() & t.isNotNull(), F.least(p, t)).otherwise(p), "total": t}
    if repair == "raise_total":
        return {"part": p, "total": F.when(p.isNotNull() & t.isNotNull(), F.greatest(p, t)).otherwise(t)}
    raise ValueError(f"unknown repair {repair}")


def bound_violations(part: Column, total: Column, part_max: float, total_max: float) -> dict[str, Column]:
    """Aggregates counting cells outside the physical bounds, before any repair."""
    return {
        "part_negative": F.count_if(part < 0), "part_above_max": F.count_if(part > part_max),
        "total_negative": F.count_if(total < 0), "total_above_max": F.count_if(total > total_max),
        "part_above_total": F.count_if(part > total),
    }


def residual_part(total: Column, other: Column, maximum: float) -> Column:
    """``total - other`` kept inside ``[0, min(maximum, total)]``."""
    return F.greatest(F.lit(0.0), F.least(total - other, F.lit(float(maximum)), total))


def symmetric_cap(control: Column, candidate: Column, cap: float, weight: float = 1.0) -> Column:
    return control + clip((candidate - control) * weight, -cap, cap)


def damped_trend(deltas: Mapping[str, float], horizon: Column, full_effect: float, max_factor: float,
                 cap: float) -> dict[str, Column]:
    """Linear response to observed changes, growing with the horizon, then capped."""
    raw = reduce(lambda a, b: a + b, [F.col(name) * float(k) for name, k in deltas.items()])
    factor = F.least(horizon / float(full_effect), F.lit(float(max_factor)))
    return {"raw": raw * factor, "applied": clip(raw * factor, -cap, cap)}


def convex(base: Column, alternate: Column, weight: float | Column, decimals: int | None = None) -> Column:
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    value = (F.lit(1.0) - w) * base + w * alternate
    return value if decimals is None else F.bround(value, decimals)


def soft_gate(control: Column, candidate: Column, probability: Column) -> Column:
    return control + probability * (candidate - control)


def uninvert_blend(blended: Column, known: Column, weight: float | Column) -> Column:
    """Recover the component of weight ``1 - w`` from a blend and its other component."""
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    return ratio(blended - w * known, F.lit(1.0) - w)


def ladder_weight(position: Column, edge: int, near: float, far: float) -> Column:
    """Weight ``near`` up to and including ``edge``, ``far`` beyond it."""
    return F.when(position <= edge, F.lit(float(near))).otherwise(F.lit(float(far)))


def gated_mixture(step: Column, parts: Mapping[str, tuple[Column, float, float]], edge: int,
                  level_ratio: Column, delta: float, scale_low: float, scale_high: float) -> Column:
    """Near/far mixture of components, rescaled by ``level_ratio`` only when it leaves ``1 +- delta``.

    ``parts`` maps a name to (value, near weight, far weight). The gate is strict.
    """
    near = reduce(lambda a, b: a + b, [v * wn for v, wn, _ in parts.values()])
    far = reduce(lambda a, b: a + b, [v * wf for v, _, wf in parts.values()])
    mixed = F.when(step <= edge, near).otherwise(far)
    return F.when(F.abs(level_ratio - 1.0) > delta, mixed * clip(level_ratio, scale_low, scale_high)).otherwise(mixed)


def swap_component(prediction: Column, old: Column, new: Column, weight: Column) -> Column:
    return F.greatest(F.lit(0.0), prediction + weight * (new - old))


def masked_scale(prediction: Column, mask: Column, scale: float | Column) -> Column:
    s = scale if isinstance(scale, Column) else F.lit(float(scale))
    return F.when(mask, prediction * s).otherwise(prediction)


def inverse_target_weight(target: Column, floor: float) -> Column:
    return F.lit(1.0) / F.greatest(F.abs(target), F.lit(float(floor)))


def low_state_weight(level_ratio: Column, threshold: float, multiplier: float) -> Column:
    return F.when(level_ratio < threshold, F.lit(float(multiplier))).otherwise(F.lit(1.0))


def odds_weight(probability: Column, low: float, high: float) -> Column:
    p = clip(probability, 1e-6, 1 - 1e-6)
    return clip(p / (F.lit(1.0) - p), low, high)


def mean_one(df: DataFrame, weight: str, groups: Sequence[str], out: str) -> DataFrame:
    """Divide a weight by its group mean.

    The means come from a map-side combined aggregate joined back, so no group is ever gathered
    into one task the way an unbounded window frame would.
    """
    means = df.groupBy(*groups).agg(F.avg(weight).alias("_mean"))
    joined = lookup_join(df, means, list(groups))
    return joined.withColumn(out, ratio(F.col(weight), F.col("_mean"))).drop("_mean")
