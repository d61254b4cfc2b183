"""Calendar encodings of an origin or of a target time (Monday is day 0)."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from tidegrid.functions.timeline import minute_of_day

TWO_PI = 2.0 * math.pi


def _wave(fraction: Column, prefix: str, harmonic: int = 1) -> dict[str, Column]:
    angle = fraction * F.lit(TWO_PI * harmonic)
    return {f"{prefix}_sin": F.sin(angle), f"{prefix}_cos": F.cos(angle)}


def calendar_columns(ts: Column | str, prefix: str = "") -> dict[str, Column]:
    """Hour, minute and weekday waves plus weekend, month and day-of-month."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    dow = F.weekday(ts)
    return {
        **_wave(minute_of_day(ts) / 1440.0, f"{prefix}hour"),
        **_wave(F.minute(ts) / 60.0, f"{prefix}minute"),
        **_wave(dow / 7.0, f"{prefix}dayofweek"),
        f"{prefix}is_weekend": (dow >= 5).cast("double"),
        f"{prefix}month": F.month(ts).cast("double"),
        f"{prefix}day_of_month": F.dayofmonth(ts).cast("double"),
    }


def day_harmonics(ts: Column | str, orders: tuple[int, ...] = (1, 2), prefix: str = "day") -> dict[str, Column]:
    ts = F.col(ts) if isinstance(ts, str) else ts
    out: dict[str, Column] = {}
    for k in orders:
        out.update(_wave(minute_of_day(ts) / 1440.0, f"{prefix}{k}", k))
    return out


def add(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(name) for name, c in columns.items()]
