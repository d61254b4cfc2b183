"""Horizon arithmetic: expansion, interval bounds, buckets, cohorts, maturity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidegrid.functions.timeline import epoch_minutes, plus_minutes

# Right-closed horizon buckets in minutes.
BUCKETS = ((120, "h015_120"), (360, "h135_360"), (720, "h375_720"), (1440, "h735_1440"))
SHORT_LIMIT = 120


def expand_horizons(df: DataFrame, horizons: Sequence[int], name: str = "horizon_minutes") -> DataFrame:
    """One row per (row, horizon) by a narrow ``explode`` of a literal array: no join, no shuffle."""
    if not horizons or any(int(h) <= 0 for h in horizons):
        raise ValueError("horizons must be positive")
    literal = F.array(*[F.lit(int(h)) for h in horizons])
    return df.select("*", F.explode(literal).alias(name))


def interval_start(origin: str, horizon: str, width: int) -> Column:
    """Start of the label interval that ends ``horizon`` minutes after the origin."""
    return plus_minutes(origin, F.col(horizon) - width)


def interval_bounds(origin: str, horizon: str, width: int) -> dict[str, Column]:
    """Inclusive first and exclusive last moment; a horizon off the interval grid fails the job."""
    ok = (F.col(horizon) > 0) & (F.col(horizon) % width == 0)
    start = F.when(F.assert_true(ok, F.lit("horizon is off the interval grid")).isNull(),
                   interval_start(origin, horizon, width))
    return {"interval_start": start, "interval_end": plus_minutes(start, width)}


def horizon_bucket(horizon: Column | str) -> Column:
    h = F.col(horizon) if isinstance(horizon, str) else horizon
    out = F.when((h >= 0) & (h <= BUCKETS[0][0]), BUCKETS[0][1])
    for upper, label in BUCKETS[1:]:
        out = out.when((h > 0) & (h <= upper), label)
    return out


def horizon_band(period: str, horizon: str, edges: dict[str, Sequence[tuple[int, str]]]) -> Column:
    """Bands whose edges depend on the forecast period."""
    out = F.lit(None).cast("string")
    for name, ladder in edges.items():
        band = None
        for upper, label in ladder:
            test = F.col(horizon) <= upper
            band = F.when(test, label) if band is None else band.when(test, label)
        out = F.when(F.col(period) == name, band).otherwise(out)
    return out


def periods_of(horizon: str, short_limit: int = SHORT_LIMIT) -> Column:
    """Every cell belongs to the long period, cells up to the limit also to the short one."""
    return F.when(F.col(horizon) <= short_limit, F.array(F.lit("short"), F.lit("long"))).otherwise(
        F.array(F.lit("long")))


def is_mature(origin: str, horizon: str, train_end: Column, *, interval: bool, sample_minutes: int) -> Column:
    """The whole label lies at or before ``train_end``."""
    slack = sample_minutes if interval else 0
    return plus_minutes(origin, F.col(horizon) - slack) <= train_end


def horizon_groups(horizons: Sequence[int], size: int) -> dict[int, int]:
    if size <= 0:
        raise ValueError("group size must be positive")
    return {int(h): i // size for i, h in enumerate(sorted(horizons))}


def horizon_step(horizon: str, width: int) -> Column:
    return (F.col(horizon) / width).cast("int")


def fold_age_minutes(origin: str, end: Column) -> Column:
    return epoch_minutes(end) - epoch_minutes(origin)
