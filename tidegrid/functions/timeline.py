"""Zone-free arithmetic on TIMESTAMP_NTZ columns, all inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EPOCH = "1970-01-01"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_minutes(ts: Column | str) -> Column:
    """Whole minutes since 1970-01-01 of the wall clock, independent of the session zone."""
    ts = _col(ts)
    days = F.datediff(F.to_date(ts), F.lit(EPOCH).cast("date"))
    return days.cast("long") * 1440 + F.hour(ts) * 60 + F.minute(ts)


def epoch_seconds(ts: Column | str) -> Column:
    return epoch_minutes(ts) * 60 + F.second(_col(ts))


def epoch_micros(ts: Column | str) -> Column:
    seconds = F.extract(F.lit("SECOND"), _col(ts)).cast("decimal(18,6)")
    return epoch_minutes(ts) * 60_000_000 + (seconds * 1_000_000).cast("long")


def as_instant(ts: Column | str) -> Column:
    """Wall clock read as UTC: watermarks need TIMESTAMP, and its windows align to UTC."""
    return F.timestamp_micros(epoch_micros(ts))


def as_wall_clock(instant: Column | str) -> Column:
    zero = F.lit(0)
    seconds = (F.unix_micros(_col(instant)).cast("decimal(24,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    return F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(zero, zero, zero, seconds)


def from_epoch_minutes(minutes: Column) -> Column:
    return F.lit(EPOCH).cast("timestamp_ntz") + minutes_interval(minutes)


def minutes_interval(minutes: Column | int) -> Column:
    if isinstance(minutes, int):
        minutes = F.lit(minutes)
    zero = F.lit(0)
    return F.make_dt_interval(zero, zero, minutes.cast("int"), F.lit(0).cast("decimal(18,6)"))


def plus_minutes(ts: Column | str, minutes: Column | int) -> Column:
    return _col(ts) + minutes_interval(minutes)


def floor_minutes(ts: Column | str, step: int) -> Column:
    """Start of the left-closed bucket of ``step`` minutes that holds ``ts``."""
    return from_epoch_minutes(F.floor(epoch_minutes(ts) / step) * step)


def minute_of_day(ts: Column | str) -> Column:
    ts = _col(ts)
    return F.hour(ts) * 60 + F.minute(ts)


def on_grid(ts: Column | str, step: int) -> Column:
    """True for timestamps that sit exactly on a grid of ``step`` minutes."""
    ts = _col(ts)
    return (epoch_minutes(ts) % step == 0) & (F.date_format(ts, "ss.SSSSSS") == "00.000000")


def on_stride(ts: Column | str, stride: int) -> Column:
    if stride <= 0:
        raise ValueError("stride must be positive")
    return F.pmod(epoch_minutes(ts), F.lit(stride)) == 0
