"""Missing-data aware scalar and row-wise expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def as_number(name: str) -> Column:
    """Text to double; cells that are not numbers become NULL."""
    return F.expr(f"try_cast(`{name}` AS DOUBLE)")


def failed_number(name: str) -> Column:
    """True where a non-null cell could not be read as a number."""
    return F.col(name).isNotNull() & as_number(name).isNull()


def mixed_timestamp(name: str, formats: Sequence[str]) -> Column:
    """First format that parses wins; nothing parses gives NULL."""
    tries = [F.expr(f"cast(try_to_timestamp(`{name}`, '{fmt}') AS timestamp_ntz)") for fmt in formats]
    return F.coalesce(*tries)


def finite(c: Column | str) -> Column:
    """NaN and both infinities become NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def ratio(top: Column, bottom: Column) -> Column:
    """Division that is NULL where the denominator is zero (ANSI mode would fail the job)."""
    return F.when(bottom != 0, top / bottom)


def observed_count(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in columns])


def filled_sum(columns: Sequence[str]) -> Column:
    """Row-wise sum, NULL counted as zero."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) for c in columns])


def observed_sum(columns: Sequence[str]) -> Column:
    """Row-wise sum that is NULL when every term is NULL."""
    return F.when(observed_count(columns) > 0, filled_sum(columns))


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise KeyError(f"missing columns: {absent}")


@dataclass(frozen=True)
class Balance:
    """``sum(plus) - sum(minus)``.

    ``null_policy``: ``strict`` propagates any NULL, ``observed`` totals each side over the
    cells present, ``zero`` reads every NULL as zero.
    """

    plus: tuple[str, ...]
    minus: tuple[str, ...] = ()
    null_policy: str = "strict"

    def column(self) -> Column:
        if self.null_policy == "strict":
            side = lambda cols: reduce(lambda a, b: a + b, [F.col(c) for c in cols])
        elif self.null_policy == "observed":
            side = observed_sum
        elif self.null_policy == "zero":
            side = filled_sum
        else:
            raise ValueError(f"unknown null policy {self.null_policy}")
        total = side(self.plus)
        return total - side(self.minus) if self.minus else total


def with_balances(df: DataFrame, spec: Mapping[str, Balance], total: str | None = None) -> DataFrame:
    """Add every balance of ``spec`` and, on request, their observed total."""
    for balance in spec.values():
        require_columns(df, [*balance.plus, *balance.minus])
    out = df.select("*", *[b.column().alias(name) for name, b in spec.items()])
    return out.withColumn(total, observed_sum(list(spec))) if total else out


def clip(c: Column, low: Column | float | None = None, high: Column | float | None = None) -> Column:
    """Bound a value, NULL stays NULL (``greatest`` alone would skip it)."""
    out = c
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(float(low)))
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(float(high)))
    return F.when(c.isNotNull(), out)
