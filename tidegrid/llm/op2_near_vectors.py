"""Near-duplicate embeddings by sorted projection passes.

Equal vectors form a class first. In each pass every class is given the signs of ``BITS`` random projections
of its own pass; classes are ordered by them lexicographically and each is compared with the next
``WINDOW`` in that order, by cosine in double precision. Verified pairs of all passes are united into
components. The first passes follow from the number of classes and the angle, for a chance of missing
a pair at the threshold itself of ``MISS``; closer pairs are missed far less often.

How crowded a row lies is measured in each pass: a pair that agrees on more bits than the row shares with
the one ``WINDOW`` places off has been compared, and the chance to agree on a bit depends on the angle alone,
however the vectors lie. Rows whose chances over all passes leave more than ``MISS`` are crowded. They get
further passes of their own while that is cheaper, and at last are all compared with one another, exactly,
in groups of two blocks of bounded size.

Windows are bounded, so a group of more near copies than a window would lose links. The links inside a
component are therefore counted exactly: members within half the angle of the component's mean direction
are all linked to one another and need no comparison; the others are compared with every member, in
blocks that are spread over tasks. No pair is emitted for this, and no group is gathered in a task.

Null, empty, zero and not wholly finite vectors, and rows without a vec_id, link with nothing and are their
own component (null for a null id). Vectors of different length are never compared. Rows that share a
vec_id count as vectors of their own. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegrid.llm.common import table
from tidegrid.llm.components import components
from tidegrid.llm.vectors import planes, unit, vectors
from tidegrid.session import cut

COSINE = 0.95
BITS, WINDOW, MISS = 62, 64, 0.005
ROWS, BLOCK = 16_384, 2_048
PASS = 1_500  # comparisons in blocks that cost as much as a row's share of a pass


def passes(classes: int, cosine: float = COSINE, window: int = WINDOW, miss: float = MISS) -> int:
    """Enough passes for pairs at the threshold: two stay within a window while they agree on the bits that order so many."""
    agree = 1 - math.acos(cosine) / math.pi
    found = agree ** max(1.0, math.log2(max(classes, 2) / window))
    return max(2, math.ceil(math.log(miss) / math.log(1 - found)))


def chances(keys: np.ndarray, run: np.ndarray, window: int, bits: int, cosine: float) -> np.ndarray:
    """-log of the chance that a pair at the threshold is not compared, for each row of a part of the sorted order.

    Beyond the part's ends nothing is known: the last row there stands for those after it, which share no more.
    """
    n = len(keys)
    agree, at = 1 - math.acos(cosine) / math.pi, np.arange(n)
    found = np.zeros(n)
    for other in (np.minimum(at + window, n - 1), np.maximum(at - window, 0)):
        apart = keys ^ keys[other]
        high = apart >> 31
        common = bits - np.where(high > 0, np.frexp(high.astype(float))[1] + 31, np.frexp((apart & ((1 << 31) - 1)).astype(float))[1])
        found += np.where(run == run[other], np.where(common < bits, agree ** (common + 1.0), 0), 1) / 2
    return -np.log1p(-np.minimum(found, 1 - 1e-9))


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest position joined to each position."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        while not np.array_equal(step := new[new], new):
            new = step
        if np.array_equal(new, label):
            break
        label = new
    return label


def _links(ids: np.ndarray, x: np.ndarray, group: np.ndarray, window: int, cosine: float) -> list[tuple[int, int]]:
    """Edges that join all linked pairs at most ``window`` apart, one for each vector at most."""
    left, right = [], []
    for d in range(1, min(window, len(ids) - 1) + 1):
        hit = np.flatnonzero((np.einsum("ij,ij->i", x[:-d], x[d:]) >= cosine) & (group[:-d] == group[d:]))
        left.append(hit)
        right.append(hit + d)
    if not left:
        return []
    label = _forest(len(ids), np.concatenate(left), np.concatenate(right))
    return [(int(ids[i]), int(ids[label[i]])) for i in np.flatnonzero(label != np.arange(len(ids)))]


def _runs(dims: np.ndarray):
    cuts = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(dims)]
    return zip(cuts[:-1], cuts[1:])


def _compare(ids, packed, group, window, cosine):
    """Edges among rows in sorted order; ``packed`` holds unit vectors as bytes, of one length per run."""
    out = []
    for a, b in _runs(np.array([len(p) for p in packed])):
        if b - a > 1:
            x = np.frombuffer(b"".join(packed[a:b])).reshape(b - a, -1)
            out += _links(np.array(ids[a:b]), x, np.array(group[a:b]), window, cosine)
    return out


EDGE = "a bigint, b bigint, part int, total int, place int, pass int, vector binary, gain double"


def _edge_batch(edges, borders=()):
    rows = [(a, b, None, None, None, None, None, None) for a, b in edges] + [(i, None, *rest, None) for i, *rest in borders]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.float64()]
    columns = list(zip(*rows)) or [[]] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [c.split()[0] for c in EDGE.split(", ")])


def near_edges(classes: DataFrame, n_passes: int, n: int, cosine: float, window: int, bits: int, first_pass: int = 0) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) between classes (id, vector) that a window of some pass has verified, and each class's ``chances`` (id, gain) over all passes."""
    weights = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)

    def hashed(batches):
        for batch in batches:
            ids, packed = batch["id"].to_numpy(), batch["vector"].to_pylist()
            for a, b in _runs(np.array([len(p) for p in packed])):
                x = np.frombuffer(b"".join(packed[a:b])).reshape(b - a, -1)
                for p in range(first_pass, first_pass + n_passes):
                    keys = (x @ planes(x.shape[1], bits, p) > 0) @ weights
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, p, np.int32)), pa.array(np.full(b - a, x.shape[1], np.int32)), pa.array(keys), pa.array(ids[a:b]), batch["vector"].slice(a, b - a)],
                                                     ["pass", "dim", "key", "id", "vector"])

    def windows(batches):
        part, first, rows, known, total = TaskContext.get().partitionId(), [], [], [], 0
        for batch in batches:
            known.append([batch[c].to_numpy().astype(np.int64) for c in ("id", "key", "pass", "dim")])
            fresh = list(zip(batch["id"].to_pylist(), batch["vector"].to_pylist(), batch["pass"].to_pylist()))
            first += fresh[: window - len(first)]
            rows += fresh
            total += len(fresh)
            yield _edge_batch(_compare([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], window, cosine))
            rows = rows[-window:]
        if known:
            ids, keys, run, dim = (np.concatenate(c) for c in zip(*known))
            gain = chances(keys, run << 32 | dim, window, bits, cosine)
            none = lambda t: pa.nulls(len(ids), t)
            yield pa.RecordBatch.from_arrays([pa.array(ids), none(pa.int64()), *[none(pa.int32())] * 4, none(pa.binary()), pa.array(gain)], [c.split()[0] for c in EDGE.split(", ")])
        # What other partitions need of this one.
        last = list(enumerate(rows, total - len(rows)))[max(0, len(first) + len(rows) - total) :]
        yield _edge_batch((), [(i, part, total, k, p, v) for k, (i, v, p) in [*enumerate(first), *last]])

    def borders(batch: pa.Table) -> pa.Table:
        rows = sorted(zip(*(batch[c].to_pylist() for c in ("position", "a", "vector", "pass"))))
        found = _compare([r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], window, cosine)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    order = ["pass", "dim", "key", "id"]
    rows = classes.mapInArrow(hashed, "pass int, dim int, key bigint, id bigint, vector binary")
    rows = rows.repartitionByRange(max(1, n * n_passes // ROWS), *order).sortWithinPartitions(*order)
    found = cut(rows.mapInArrow(windows, EDGE))
    inner = found.where("b IS NOT NULL").select("a", "b")
    ends = found.where("part IS NOT NULL")
    # One row for each partition that isn't empty: where it begins in the whole order.
    sizes = sorted(map(tuple, ends.groupBy("part").agg(F.max("total")).collect()))
    begin = np.concatenate([[0], np.cumsum([size for _, size in sizes])]).astype(np.int64)
    offset, starts = {part: int(at) for (part, _), at in zip(sizes, begin)}, begin[1:-1]

    def placed(batches):
        # A row meets all rows across each beginning that lies within a window of it, however short the partitions between.
        for batch in batches:
            position = np.array([offset[p] + k for p, k in zip(batch["part"].to_pylist(), batch["place"].to_pylist())], np.int64)
            low, high = np.searchsorted(starts, position - window, "right"), np.searchsorted(starts, position + window, "right")
            at = np.repeat(np.arange(len(position)), high - low)
            border = np.arange(len(at)) - np.repeat(np.cumsum(high - low) - high, high - low)
            yield pa.RecordBatch.from_arrays([pa.array(border), pa.array(position[at]), *(batch[c].take(pa.array(at)) for c in ("a", "vector", "pass"))], ["border", "position", "a", "vector", "pass"])

    across = ends.mapInArrow(placed, "border bigint, position bigint, a bigint, vector binary, pass int")
    edges = inner.unionByName(across.groupBy("border").applyInArrow(borders, "a bigint, b bigint"))
    return edges, found.where("gain IS NOT NULL").groupBy(F.col("a").alias("id")).agg(F.sum("gain").alias("gain"))


def block_edges(classes: DataFrame, n: int, cosine: float, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that join all linked pairs of ``classes`` (id, vector), compared each with each in blocks."""
    k = max(1, -(-n // min(block, max(256, n // 16))))
    copies = classes.select("id", "vector", F.length("vector").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(k)).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("other"))

    def compare(group: pa.Table) -> pa.Table:
        ids, own, i, j = (group[c].to_numpy() for c in ("id", "own", "i", "j"))
        x = np.frombuffer(b"".join(group["vector"].to_pylist())).reshape(len(ids), -1)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        a, b = np.nonzero(x[left] @ x[right].T >= cosine)
        label = _forest(len(ids), left[a], right[b])
        joined = np.flatnonzero(label != np.arange(len(ids)))
        return pa.table({"a": ids[joined], "b": ids[label[joined]]})

    pairs = copies.select("id", "vector", "dim", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return pairs.groupBy("dim", "i", "j").applyInArrow(compare, "a bigint, b bigint")


def all_edges(classes: DataFrame, n: int, cosine: float, window: int, miss: float, bits: int) -> DataFrame:
    """Edges of passes over all ``classes`` (id, vector), and of the crowded ones' own passes and blocks."""
    enough, done, run = -math.log(miss), 0, passes(n, cosine, window, miss)
    edges, gains = near_edges(classes, run, n, cosine, window, bits)
    while True:
        done += run
        gains = cut(gains)
        left = classes.join(gains.where(F.col("gain") < enough), "id")
        more = F.ceil((enough - F.col("gain")) / F.greatest(F.col("gain"), F.lit(1e-9)) * done)
        few = left.agg(F.count("*").alias("n"), F.percentile_approx(more, 0.9).alias("more")).first()
        if not few["n"]:
            return edges
        if few["more"] * PASS >= few["n"] / 2:
            return edges.unionByName(block_edges(left.select("id", "vector"), few["n"], cosine))
        run = few["more"]
        fresh, gained = near_edges(left.select("id", "vector"), run, few["n"], cosine, window, bits, done)
        edges = edges.unionByName(fresh)
        gains = gains.where(F.col("gain") < enough).unionByName(gained).groupBy("id").agg(F.sum("gain").alias("gain"))


def _means(members: DataFrame) -> DataFrame:
    """The mean direction of each component; every batch adds up its own part first."""
    def part(batches):
        for batch in batches:
            sums: dict[int, np.ndarray] = {}
            for c, v, n in zip(*(batch[k].to_pylist() for k in ("component", "vector", "n"))):
                x = np.frombuffer(v)
                sums[c] = sums[c] + x if c in sums else x.copy()
            yield pa.RecordBatch.from_pydict({"component": pa.array(list(sums), pa.int64()), "mean": pa.array([s.tobytes() for s in sums.values()], pa.binary())})

    def whole(group: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(s) for s in group["mean"].to_pylist()], axis=0)
        total = unit(total) if total.any() else total
        return pa.table({"component": group["component"][:1], "mean": pa.array([total.tobytes()], pa.binary())})

    schema = "component bigint, mean binary"
    return members.mapInArrow(part, schema).groupBy("component").applyInArrow(whole, schema)


def linked_weight(members: DataFrame, cosine: float, block: int = BLOCK) -> DataFrame:
    """(id, weight): rows of other classes in the same component linked directly, exactly.

    ``members``: (component, id, vector, n) of components of two classes or more.
    """
    half = math.cos(math.acos(cosine) / 2) + 1e-9

    def split(batches):
        for batch in batches:
            core = [bool(np.frombuffer(v) @ np.frombuffer(m) >= half) for v, m in zip(batch["vector"].to_pylist(), batch["mean"].to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("component", "id", "vector", "n")), pa.array(core)], ["component", "id", "vector", "n", "core"])

    rows = cut(members.join(_means(members), "component").mapInArrow(split, "component bigint, id bigint, vector binary, n bigint, core boolean"))
    sizes = rows.groupBy("component").agg(F.count("*").alias("members"), F.count_if(~F.col("core")).alias("outer"), F.sum(F.when(F.col("core"), F.col("n")).otherwise(0)).alias("core_n"))
    rows = rows.join(sizes, "component")
    inner = rows.where("core").select("id", (F.col("core_n") - F.col("n")).alias("weight"))
    # Blocks of members against blocks of outer members.
    blocks = lambda c: F.ceil(F.col(c) / block).cast("int")
    spread = lambda c: F.pmod(F.xxhash64("id"), blocks(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), blocks(c) - 1))
    some = rows.where("outer > 0")
    left = some.select("component", "id", "vector", "n", "core", F.lit(False).alias("probe"), spread("members").alias("i"), every("outer").alias("j"))
    right = some.where("NOT core").select("component", "id", "vector", "n", "core", F.lit(True).alias("probe"), every("members").alias("i"), spread("outer").alias("j"))

    def count(group: pa.Table) -> pa.Table:
        probe = group["probe"].to_numpy()
        ids, n, core = (group[c].to_numpy() for c in ("id", "n", "core"))
        x = np.frombuffer(b"".join(group["vector"].to_pylist())).reshape(len(ids), -1)
        near = (x[probe] @ x[~probe].T >= cosine) & (ids[probe][:, None] != ids[~probe])
        back = (near & core[~probe]).T @ n[probe]  # a core member learns of its outer ones here alone
        return pa.table({"id": np.concatenate([ids[probe], ids[~probe]]), "weight": np.concatenate([near @ n[~probe], back]).astype(np.int64)})

    pairs = left.unionByName(right).groupBy("component", "i", "j").applyInArrow(count, "id bigint, weight bigint")
    return inner.unionByName(pairs).groupBy("id").agg(F.sum("weight").alias("weight"))


def near_vectors(embeddings: DataFrame, cosine: float = COSINE, window: int = WINDOW, miss: float = MISS, bits: int = BITS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    def read(batches):
        for batch in batches:
            units = [None if v is None or i is None else unit(v).tobytes() for i, v in zip(batch["vec_id"].to_pylist(), vectors(batch["embedding"]))]
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array([u and sha256(u).digest()[:16] for u in units], pa.binary()), pa.array(units, pa.binary())], ["vec_id", "class", "vector"])

    rows = cut(embeddings.select(F.col("vec_id").cast("bigint"), "embedding").mapInArrow(read, "vec_id bigint, class binary, vector binary"))
    classes = cut(rows.where("class IS NOT NULL").groupBy("class").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("vector").alias("vector")))
    n = classes.count()
    whole = components(all_edges(classes.select("id", "vector"), n, cosine, window, miss, bits))
    whole = cut(whole)
    members = cut(classes.join(whole, "id").select("component", "id", "vector", "n"))
    weights = linked_weight(members, cosine)
    known = classes.join(whole, "id", "left").join(weights, "id", "left").select("class", (F.col("n") - 1 + F.coalesce("weight", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = rows.select("vec_id", "class").join(known, "class", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
