"""Nearest neighbours by collision counting over sorted projections.

Vectors are dealt into blocks of bounded size. A block's index is one sorted array per random projection.
Around a query's own value in each array a window is opened and widened step by step (virtual rehashing:
the arrays stay, the radius grows); a vector collides in a projection when it lies in that window. Vectors
that collide in ``COLLISIONS`` of all projections are candidates, and the radius grows until there are
``SHARE`` of the block, ``LEAST`` at least. All candidates are verified by inner product in double
precision on the original vectors, however many there are; the best of all blocks are merged per query.

Inner products become distances by scaling to the longest vector of the block and adding the coordinate
that completes each vector to that length. Projections are orthogonal in groups of the dimension.

Null, empty, zero and not wholly finite vectors and rows without vec_id take no part, neither do vectors
whose length differs from the query's. Rows that share a vec_id are vectors of their own; a query leaves
out its own row only. Ties go to the smaller vec_id. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidegrid.llm.common import table
from tidegrid.llm.vectors import vectors
from tidegrid.session import cut

K = 20
BLOCK, QUERIES = 16_384, 1_024
COLLISIONS, SHARE, LEAST = 0.75, 0.12, 600
RADIUS, GROWTH = 1.0, 1.1
_RESULT = "query bigint, query_id bigint, vec_id bigint, score double"


def directions(dim: int, seed: int = 7) -> np.ndarray:
    """At least 64 directions, orthogonal in groups, scaled so that a unit vector's projections vary by about 1."""
    random = np.random.default_rng([seed, dim])
    groups = [np.linalg.qr(random.standard_normal((dim, dim)))[0] for _ in range(-(-64 // dim))]
    return np.hstack(groups) * np.sqrt(dim)


def search_block(base: np.ndarray, ids: np.ndarray, own: np.ndarray, queries: np.ndarray, query_own: np.ndarray, k: int, share: float, least: int):
    """(query, base row, score) of the k best candidates of every query; ``own`` tells a query's own row."""
    n, dim = base.shape
    longest = np.sqrt((base * base).sum(1).max())
    unit = base / longest
    unit = np.hstack([unit, np.sqrt(np.maximum(0, 1 - (unit * unit).sum(1)))[:, None]])
    asked = np.hstack([queries / np.sqrt((queries * queries).sum(1))[:, None], np.zeros((len(queries), 1))])
    planes = directions(dim + 1)
    values, centres = unit @ planes, asked @ planes
    m = planes.shape[1]
    order = np.argsort(values, axis=0, kind="stable").T.astype(np.int32).copy()
    arrays = np.sort(values, axis=0).T.copy()
    need, enough = min(n, max(least, int(share * n), 2 * k)), int(np.ceil(COLLISIONS * m))
    edges: list[tuple[np.ndarray, np.ndarray]] = []  # window ends by radius, for all queries

    def window(step: int):
        while len(edges) <= step:
            r = RADIUS * GROWTH ** len(edges)
            edges.append(tuple(np.stack([np.searchsorted(arrays[i], centres[:, i] + s * r, side) for i in range(m)], 1) for s, side in ((-1, "left"), (1, "right"))))
        return edges[step]

    for q in range(len(queries)):
        counts, found, step = np.zeros(n, np.int64), np.arange(n), 0
        low = high = None
        while need < n:
            lo, hi = (e[q] for e in window(step))
            if low is None:
                parts = [order[i, lo[i] : hi[i]] for i in range(m)]
            else:
                parts = [order[i, a:b] for i in range(m) for a, b in ((lo[i], low[i]), (high[i], hi[i])) if a < b]
            low, high, step = lo, hi, step + 1
            if parts:
                counts += np.bincount(np.concatenate(parts), minlength=n)
            found = np.flatnonzero(counts >= enough)
            if len(found) >= need:
                break
        found = found[own[found] != query_own[q]]
        score = (base[found] * queries[q]).sum(1)
        if len(found) > k:
            kept = np.flatnonzero(score >= np.partition(score, -k)[-k])
            found, score = found[kept], score[kept]
        best = np.lexsort((ids[found], -score))[:k]
        yield q, found[best], score[best]


def search(vectors_table: DataFrame, is_query: Column, k: int = K, share: float = SHARE, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best found for every row where ``is_query`` holds, against all rows."""
    def read(batches):
        for batch in batches:
            units = [None if v is None or i is None else v.tobytes() for i, v in zip(batch["vec_id"].to_pylist(), vectors(batch["embedding"]))]
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["query"], pa.array(units, pa.binary())], ["vec_id", "query", "vector"])

    rows = vectors_table.select(F.col("vec_id").cast("bigint"), "embedding", F.coalesce(is_query, F.lit(False)).alias("query"))
    rows = rows.mapInArrow(read, "vec_id bigint, query boolean, vector binary").where("vector IS NOT NULL")
    rows = cut(rows.withColumns({"own": F.monotonically_increasing_id(), "dim": F.octet_length("vector")}))
    sizes = rows.groupBy("dim").agg((F.count("*") / block).alias("b"), (F.count_if("query") / QUERIES).alias("q"))
    blocks = sizes.select("dim", F.ceil("b").cast("int").alias("blocks"), F.ceil("q").cast("int").alias("parts"))
    rows = rows.join(F.broadcast(blocks) if blocks.count() <= 1000 else blocks, "dim")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    dealt = lambda c: F.pmod(F.xxhash64("own"), c).cast("int")
    base = rows.where("parts > 0").select("own", "vec_id", "vector", "dim", F.lit(False).alias("asks"), dealt("blocks").alias("i"), every("parts").alias("j"))
    asked = rows.where("query").select("own", "vec_id", "vector", "dim", F.lit(True).alias("asks"), every("blocks").alias("i"), dealt("parts").alias("j"))

    def run(group: pa.Table) -> pa.Table:
        asks = group["asks"].to_numpy()
        own, ids = group["own"].to_numpy(), group["vec_id"].to_numpy()
        x = np.frombuffer(b"".join(group["vector"].to_pylist())).reshape(len(own), -1)
        out = [(np.full(len(f), own[asks][q]), np.full(len(f), ids[asks][q]), ids[~asks][f], s)
               for q, f, s in search_block(x[~asks], ids[~asks], own[~asks], x[asks], own[asks], k, share, least)] if asks.any() and not asks.all() else []
        columns = [np.concatenate(c) for c in zip(*out)] or [[]] * 4
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query", "query_id", "vec_id", "score"), columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))})

    found = base.unionByName(asked).groupBy("dim", "i", "j").applyInArrow(run, _RESULT)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
