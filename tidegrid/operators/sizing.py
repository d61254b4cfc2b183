"""Equi-joins by named keys in which NULL is a key like any other."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from tidegrid.session import cut

SALTS = 64   # parts of the rows whose keys hold a NULL


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL equals NULL; the keys appear once, from the side that has them."""
    right = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    joined = left.join(right, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys], how)
    if how in ("full", "right"):
        joined = joined.withColumns({k: F.coalesce(k, f"_right_{k}") for k in keys})
    return joined.drop(*[f"_right_{k}" for k in keys])


def _any_null(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])


def _flat(kind: DataType) -> bool:
    return not isinstance(kind, (ArrayType, MapType, StructType))


def keyed_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """``join_keys`` for sides where one key may hold a third of all rows: inner, left, semi or anti.

    Rows with equal keys that aren't NULL are a skewed join, which AQE splits. NULL is the usual hot key of
    raw data (no user, no site), so its rows are also dealt over ``SALTS`` parts by a hash of
    their own values, and the few right rows with a NULL key are given to each part: every left
    row still meets every match exactly once. The hash repeats, so a recomputed task deals the same.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"rows of the right side would repeat in a {how} join")
    on = list(on)
    may_be_null = [f.name for f in left.schema if f.name in on and f.nullable]
    may_be_null = [k for k in may_be_null if right.schema[k].nullable]
    if not may_be_null:
        return join_keys(left, right, on, how)
    own = [F.col(f"`{f.name}`") for f in left.schema if f.name not in on and _flat(f.dataType)]
    part = F.pmod(F.xxhash64(*own), F.lit(SALTS)).cast("int") if own else F.lit(0)
    left = left.withColumn("_salt", F.when(_any_null(may_be_null), part).otherwise(0))
    right = right.withColumnsRenamed({k: f"_right_{k}" for k in on})
    every = F.when(_any_null([f"_right_{k}" for k in may_be_null]), F.sequence(F.lit(0), F.lit(SALTS - 1)))
    right = right.withColumn("_right_salt", F.explode(every.otherwise(F.array(F.lit(0)))))
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) if k in may_be_null else F.col(k) == F.col(f"_right_{k}") for k in on]
    joined = left.join(right, [*same, F.col("_salt") == F.col("_right_salt")], how)
    return joined.drop("_salt", "_right_salt", *[f"_right_{k}" for k in on])


def lookup_join(fact: DataFrame, side: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """``keyed_join`` with a lookup whose size is checked by writing it out first.

    The side is read back from a file, so Catalyst knows its real size: below
    ``spark.sql.autoBroadcastJoinThreshold`` the large table is not shuffled at all, above it the
    join shuffles by key and hot keys are split. No hint is forced either way.
    """
    return keyed_join(fact, cut(side), on, how)
