"""Connected components of a written edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidegrid.session import cut


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable from each id of ``edges(a, b)``; ids without edges are left out.

    Alternating large and small stars: every vertex hands the smallest neighbour it knows to the others,
    until each hangs on the smallest of its component. A star's minimum is an aggregate, joined back, so
    no neighbour list is ever gathered; a vertex with very many neighbours is a skewed join, which is split.
    The number of rounds grows with the logarithm of the longest path. Each round is a written table.
    """
    known = cut(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = known.union(known.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        # a > b now holds throughout, so the neighbours left are the smaller ones.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        known = cut(small.select("e.*").where("a != b").distinct())
        found = known.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == mark:
            break
        mark = found
    return known.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        known.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
