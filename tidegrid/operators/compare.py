"""Differences between two tables or two forecasts of the same cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidegrid.operators.sizing import join_keys


def table_diff(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str],
               epsilon: float = 0.0) -> DataFrame:
    """Per column: cells on both sides, only left, only right, changed, mean and largest change."""
    cells = lambda d, n: d.unpivot(list(keys), list(columns), "column_name", n)
    both = join_keys(cells(left, "_a").withColumn("_in_a", F.lit(1)), cells(right, "_b").withColumn("_in_b", F.lit(1)), [*keys, "column_name"], "full")
    delta = F.abs(F.col("_b") - F.col("_a"))
    changed = (F.col("_a").isNull() != F.col("_b").isNull()) | (delta > epsilon)
    paired = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    return both.groupBy("column_name").agg(
        F.count_if(paired).alias("shared_cells"), F.count_if(F.col("_in_b").isNull()).alias("only_left"),
        F.count_if(F.col("_in_a").isNull()).alias("only_right"),
        F.count_if(paired & F.coalesce(changed, F.lit(False))).alias("changed_cells"),
        F.avg(F.when(paired, delta)).alias("mean_abs_change"), F.max(F.when(paired, delta)).alias("max_abs_change"))


def block_change(before: DataFrame, after: DataFrame, keys: Sequence[str], frozen: Column) -> DataFrame:
    """Change statistics of the frozen block (must stay untouched) and of the open one."""
    joined = join_keys(before.withColumnRenamed("prediction", "_a"), after.select(*keys, F.col("prediction").alias("_b")), list(keys), "full")
    delta = F.abs(F.col("_b") - F.col("_a"))
    table = joined.groupBy(F.when(frozen, "frozen").otherwise("open").alias("block")).agg(
        F.count(F.lit(1)).alias("cells"),
        F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("changed_cells"),
        F.avg(delta).alias("mean_abs_change"), F.max(delta).alias("max_abs_change"))
    return table.withColumn("unchanged", F.col("changed_cells") == 0)


def boundary_overlap(train: DataFrame, test: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shared key rows of two partitions and how many of them agree in every column."""
    values = [c for c in train.columns if c not in keys]
    same = F.lit(True)
    for c in values:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return train.alias("a").join(test.alias("b"), condition).agg(
        F.count(F.lit(1)).alias("overlap_rows"), F.count_if(same).alias("identical_rows"))


def key_sets(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union, intersection and both differences of two key sets."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    count = lambda name, d: d.agg(F.count(F.lit(1)).alias("keys")).select(F.lit(name).alias("measure"), "keys")
    return (count("union", a.union(b).distinct()).unionByName(count("intersect", a.intersect(b)))
            .unionByName(count("left_only", a.exceptAll(b))).unionByName(count("right_only", b.exceptAll(a))))


def union_forecasts(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows held by one side only; empty when the tables are equal as bags."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(
        right.exceptAll(left).withColumn("side", F.lit("right")))
