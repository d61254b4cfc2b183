"""Wide and long forms of forecast tables and tariffs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F


def result_columns(targets: Sequence[str], horizons: Sequence[int]) -> list[str]:
    return [f"{t}_t+{h}_pred" for t in targets for h in horizons]


def to_wide(df: DataFrame, keys: Sequence[str], targets: Sequence[str], horizons: Sequence[int]) -> DataFrame:
    """One row per origin, one column per target and horizon; values are declared, not discovered."""
    name = F.concat(F.col("target"), F.lit("_t+"), F.col("horizon_minutes").cast("string"), F.lit("_pred"))
    names = result_columns(targets, horizons)
    return df.withColumn("_name", name).groupBy(*keys).pivot("_name", names).agg(F.max("prediction"))


def to_long(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    cells = df.unpivot(list(keys), list(columns), "_name", "prediction")
    pattern = r"^(.*)_t\+(\d+)_pred$"
    return cells.select(*keys, F.regexp_extract("_name", pattern, 1).alias("target"),
                        F.regexp_extract("_name", pattern, 2).cast("int").alias("horizon_minutes"), "prediction")


def restore_names(df: DataFrame, keys: Sequence[str], renames: Mapping[str, str]) -> DataFrame:
    """Current-value features back under their raw names, in the declared order."""
    return df.select(*keys, *[F.col(f"`{feature}`").alias(raw) for feature, raw in renames.items()])


def tariff_long(wide: DataFrame, slot: str, months: Sequence[str]) -> DataFrame:
    """Price table with one column per month to (month, half_hour, price)."""
    return wide.unpivot([slot], list(months), "_month", "price").select(
        F.regexp_extract("_month", r"(\d+)", 1).cast("int").alias("month"), F.col(slot).alias("half_hour"), "price")


def lookup_tariff(df: DataFrame, tariff: DataFrame, ts: str) -> DataFrame:
    """Known price of the target moment; at most 12 x 48 rows, hence the broadcast."""
    keyed = df.withColumns({"month": F.month(ts), "half_hour": F.hour(ts) * 2 + F.floor(F.minute(ts) / 30).cast("int")})
    return keyed.join(F.broadcast(tariff), ["month", "half_hour"], "left")
