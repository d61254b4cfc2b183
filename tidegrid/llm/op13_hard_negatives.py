"""Hard negatives for contrastive training from an STR-packed R-tree.

Vectors become whole numbers (floor of 256 times each component) and are packed by sort-tile-recursion: sorted
by label and first coordinate into slabs, each slab by the next coordinate into groups of ``GROUP`` rows, each
group by its own widest coordinates into leaves of ``LEAF``. Leaves, groups and nodes of ``FAN`` groups each
keep a minimum bounding box and their range of labels; the tree is a written table, a row per group.

A box gives an interval for the inner product with an anchor, summed over coordinates. Anchors are searched in
the batches of their own group:

* at home first: leaves are taken from a queue, highest bound first. A leaf is scored for those anchors whose
  interval meets a score window and isn't strictly below the k-th best found there so far;
* then the batch goes down the tree in rounds of joins with its own box, the least of its k-th scores and its
  windows, and only groups that may still matter are searched, by the same queue.

Positives are one search without a window among rows of the label, negatives one with a window for each
positive among all others. The result is exact. Boxes of many coordinates without structure prune little, and
then every anchor meets every row: batch by group, never row by row, in tasks of bounded size that return at most k rows
for each anchor and window.

Rows with a null vec_id, label or vector or a null or non-finite component take no part, neither do rows whose
vectors differ in length from the anchor's. Rows that share a vec_id are rows of their own; an anchor leaves out
its own row only. Zero vectors take part. Scores are exact below 2**59 and count as that beyond. Extra columns
are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidegrid.llm.common import table
from tidegrid.session import cut

GROUP, LEAF, FAN, BATCH = 16_384, 128, 64, 256
SCALE, ANCHORS, SHIFTED, LABELS = 256, 100, 7, 10
POSITIVES, NEGATIVES, LOWEST, HIGHEST = 5, 10, 3, 9  # tenths of the positive's score
FAR = 1 << 59
BASE = "own bigint, vec_id bigint, label bigint, dim int, x double, y double, vector binary"
FOUND = np.dtype([("own", "<i8"), ("slot", "<i8"), ("score", "<i8"), ("vec_id", "<i8"), ("row", "<i8")])
ASK = np.dtype([("own", "<i8"), ("slot", "<i8"), ("low", "<i8"), ("high", "<i8"), ("least", "<i8")])


def whole_vectors(rows: DataFrame) -> DataFrame:
    """``BASE`` of the rows that take part; ``x`` and ``y`` are the first two coordinates."""
    def run(batches):
        for batch in batches:
            kept, vectors = [], []
            for i, v in enumerate(batch["embedding"]):
                if v.is_valid:
                    v = np.floor(SCALE * v.values.cast(pa.float64()).to_numpy(zero_copy_only=False))
                    if np.isfinite(v).all():
                        kept.append(i), vectors.append(v)
            out = batch.take(pa.array(kept, pa.int64()))
            first = [pa.array([v[k] if len(v) > k else 0.0 for v in vectors], pa.float64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([out["own"], out["vec_id"], out["label"], pa.array([len(v) for v in vectors], pa.int32()), *first, pa.array([v.tobytes() for v in vectors], pa.binary())],
                                             [c.split()[0] for c in BASE.split(", ")])

    label = F.col("label").cast("bigint")
    label = F.when(F.col("vec_id") % SHIFTED == 0, (label + 1) % LABELS).otherwise(label)
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    return cut(rows.select(F.monotonically_increasing_id().alias("own"), F.col("vec_id").cast("bigint").alias("vec_id"), label.alias("label"), "embedding").mapInArrow(run, BASE))


def ranked(rows: DataFrame, *keys: str) -> DataFrame:
    """Adds ``rank`` from 0 by ``keys``, which must be unique: sorted by ranges, then counted per range."""
    rows = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    sizes = cut(sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before")))  # a row per range
    return rows.withColumn("_part", part).join(sizes, "_part").withColumn("rank", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_before")


def tiled(x: np.ndarray, rows: np.ndarray, size: int) -> list[np.ndarray]:
    """Leaves of at most ``size`` rows: slabs of whole leaves along the coordinate that varies most, each again along its own."""
    if len(rows) <= size:
        return [rows]
    pages = -(-len(rows) // size)
    wide = int(np.argmax(x[rows].var(0))) if x.shape[1] else 0
    order = rows[np.argsort(x[rows, wide], kind="stable")] if x.shape[1] else rows
    step = size * -(-pages // min(pages, max(2, math.isqrt(pages))))
    return [leaf for i in range(0, len(order), step) for leaf in tiled(x, order[i : i + step], size)]


TREE = "dim int, grp bigint, ends binary, rows binary, vectors binary, low binary, high binary, box_low binary, box_high binary, label_low bigint, label_high bigint"


def pack(base: DataFrame, group: int = GROUP, leaf: int = LEAF) -> DataFrame:
    """The tree's groups: rows (own, vec_id, label) and vectors in the order of leaves, the leaves' boxes, the group's box."""
    n = base.count()
    groups = max(1, -(-n // group))
    slab = group * -(-groups // math.ceil(math.sqrt(groups)))
    slabs = ranked(base, "dim", "label", "x", "own").withColumn("slab", F.floor(F.col("rank") / slab)).drop("rank")
    rows = ranked(slabs, "slab", "y", "own").withColumn("grp", F.floor(F.col("rank") / group))

    def build(part: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(part["vector"].to_pylist()), float).reshape(part.num_rows, part["dim"][0].as_py())
        leaves = tiled(x, np.arange(len(x)), leaf)
        order = np.concatenate(leaves)
        known = np.stack([part[c].to_numpy() for c in ("own", "vec_id", "label")], 1)[order]
        low, high = (np.stack([f(x[l], 0) for l in leaves]) for f in (np.min, np.max))
        exact = x[order].astype("<i2") if np.abs(x).max(initial=0) < 1 << 15 else x[order]
        blobs = [np.cumsum([len(l) for l in leaves]), known, exact, low, high, low.min(0), high.max(0)]
        row = [part["dim"][0].as_py(), part["grp"][0].as_py(), *(b.tobytes() for b in blobs), int(known[:, 2].min()), int(known[:, 2].max())]
        return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.int32(), pa.int64(), *[pa.binary()] * 7, pa.int64(), pa.int64()])], [c.split()[0] for c in TREE.split(", ")])

    return cut(rows.groupBy("dim", "grp").applyInArrow(build, TREE))


class Tree:
    """One group of the tree in a task."""

    def __init__(self, row: dict):
        dim = row["dim"]
        self.ends = np.frombuffer(row["ends"], np.int64)
        self.own, self.ids, self.labels = np.frombuffer(row["rows"], np.int64).reshape(-1, 3).T
        n = len(self.own)
        narrow = len(row["vectors"]) == 2 * n * dim
        self.x = np.frombuffer(row["vectors"], "<i2" if narrow else float).reshape(n, dim).astype(float)
        self.low, self.high = (np.frombuffer(row[c], float).reshape(len(self.ends), dim) for c in ("low", "high"))

    def search(self, anchors: np.ndarray, own: np.ndarray, label: np.ndarray, asks: np.ndarray, at: np.ndarray, k: int, same: bool) -> np.ndarray:
        """The best ``k`` rows (``FOUND``) of each ask, by score and then vec_id; ``at`` is the ask's anchor.

        ``least`` of an ask is a score below which nothing counts; it rises with the k-th best found.
        """
        least = np.maximum(asks["low"], asks["least"]).copy()
        up = np.maximum(anchors, 0) @ self.high.T + np.minimum(anchors, 0) @ self.low.T
        down = np.maximum(anchors, 0) @ self.low.T + np.minimum(anchors, 0) @ self.high.T
        if _inexact(anchors, self.low, self.high):  # bounds stay on the safe side
            up, down = up + np.abs(up) * 1e-9, down - np.abs(down) * 1e-9
        queue = [(-b, leaf) for leaf, b in enumerate(up.max(0, initial=-np.inf))]
        heapq.heapify(queue)
        best = np.zeros(0, FOUND)
        place = np.zeros(0, np.int64)  # of each best row, its ask
        while queue:
            bound, leaf = heapq.heappop(queue)
            if -bound < least.min(initial=0):
                break
            live = np.flatnonzero((up[at, leaf] >= least) & (down[at, leaf] <= asks["high"]) & (asks["low"] <= asks["high"]))
            if not len(live):
                continue
            rows = slice(self.ends[leaf - 1] if leaf else 0, self.ends[leaf])
            who, back = np.unique(at[live], return_inverse=True)
            score = products(anchors[who], self.x[rows])
            fits = (self.labels[rows] == label[who][:, None]) == same
            fits &= self.own[rows] != own[who][:, None]
            score_of = score[back]
            i, j = np.nonzero(fits[back] & (score_of >= least[live][:, None]) & (score_of <= asks["high"][live][:, None]))
            if not len(i):
                continue
            fresh = np.zeros(len(i), FOUND)
            fresh["own"], fresh["slot"], fresh["score"] = asks["own"][live[i]], asks["slot"][live[i]], score_of[i, j]
            fresh["vec_id"], fresh["row"] = self.ids[rows][j], self.own[rows][j]
            best, place = np.concatenate([best, fresh]), np.concatenate([place, live[i]])
            order = np.lexsort((best["row"], best["vec_id"], -best["score"], place))
            best, place = best[order], place[order]
            start = np.searchsorted(place, place)
            kept = np.arange(len(place)) - start < k
            best, place = best[kept], place[kept]
            full, count = np.unique(place, return_counts=True)
            last = np.cumsum(count) - 1
            least[full[count == k]] = np.maximum(least[full[count == k]], best["score"][last[count == k]])
        return best


def _inexact(*parts: np.ndarray) -> bool:
    a, b = np.abs(parts[0]).max(initial=0), max(np.abs(p).max(initial=0) for p in parts[1:])
    return float(a) * float(b) * max(parts[0].shape[1], 1) >= 1 << 53


def products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products, at most ``FAR`` in size; beyond what doubles hold by Python's integers."""
    if not _inexact(a, x):
        return np.clip(a @ x.T, -FAR, FAR).astype(np.int64)
    whole = lambda v: np.array([[int(c) for c in r] for r in v], object).reshape(v.shape)
    return np.clip(whole(a).dot(whole(x).T), -FAR, FAR).astype(np.int64)


BATCHES = "dim int, home bigint, chunk int, anchors binary, vectors binary, asks binary, box_low binary, box_high binary, label_low bigint, label_high bigint, least bigint, most bigint, found binary"


def at_home(tree: DataFrame, asks: DataFrame, k: int, same: bool) -> DataFrame:
    """``BATCHES``: the asks of up to ``BATCH`` anchors of a group with what their own group gives."""
    def run(groups: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if groups.num_rows and asked.num_rows:
            here = Tree(groups.to_pylist()[0])
            ask = np.zeros(asked.num_rows, ASK)
            for c in ("own", "slot", "low", "high"):
                ask[c] = asked[c].to_numpy()
            ask["least"] = -FAR
            ask = np.sort(ask, order=["own", "slot"])
            order = np.argsort(here.own)
            anchors = np.unique(ask["own"])
            spot = order[np.searchsorted(here.own, anchors, sorter=order)]
            for chunk, start in enumerate(range(0, len(anchors), BATCH)):
                own, rows = anchors[start : start + BATCH], spot[start : start + BATCH]
                mine = ask[np.searchsorted(ask["own"], own[0]) : np.searchsorted(ask["own"], own[-1], "right")].copy()
                x, label = here.x[rows], here.labels[rows]
                found = here.search(x, own, label, mine, np.searchsorted(own, mine["own"]), k, same)
                place = np.searchsorted(_key(mine), _key(found))
                full = np.flatnonzero(np.bincount(place, minlength=len(mine)) == k)
                mine["least"][full] = found["score"][np.searchsorted(place, full, "right") - 1]
                open_ = mine[mine["low"] <= mine["high"]]
                least, most = (int(np.maximum(open_["low"], open_["least"]).min()), int(open_["high"].max())) if len(open_) else (1, 0)
                out.append((groups["dim"][0].as_py(), groups["grp"][0].as_py(), chunk, np.stack([own, label], 1).tobytes(), x.tobytes(), mine.tobytes(),
                            x.min(0).tobytes(), x.max(0).tobytes(), int(label.min()), int(label.max()), least, most, found.tobytes()))
        types = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 5, *[pa.int64()] * 4, pa.binary()]
        columns = zip(*out) if out else [[] for _ in types]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [c.split()[0] for c in BATCHES.split(", ")])

    return cut(tree.groupBy("dim", "grp").cogroup(asks.groupBy("dim", "grp")).applyInArrow(run, BATCHES))


def _key(rows: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows), [("own", "<i8"), ("slot", "<i8")])
    out["own"], out["slot"] = rows["own"], rows["slot"]
    return out


def levels(tree: DataFrame) -> list[DataFrame]:
    """Boxes (dim, node, ...) of all nodes, the groups first; each next level holds ``FAN`` of the one before, up to ``FAN`` at most."""
    boxes = ["box_low", "box_high", "label_low", "label_high"]
    out = [cut(tree.select("dim", F.col("grp").alias("node"), *boxes))]

    def join(part: pa.Table) -> pa.Table:
        low, high = (f([np.frombuffer(b, float) for b in part[c].to_pylist()], 0).tobytes() for f, c in ((np.min, "box_low"), (np.max, "box_high")))
        row = [part["dim"][0].as_py(), part["above"][0].as_py(), low, high, min(part["label_low"].to_pylist()), max(part["label_high"].to_pylist())]
        return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()])], ["dim", "node", *boxes])

    while (out[-1].agg(F.max("node")).first()[0] or 0) >= FAN:
        out.append(cut(out[-1].withColumn("above", F.floor(F.col("node") / FAN)).groupBy("dim", "above").applyInArrow(join, out[-1].schema)))
    return out


def descend(batches: DataFrame, nodes: list[DataFrame], same: bool) -> DataFrame:
    """(dim, home, chunk, grp): the other groups that may still matter to a batch."""
    def test(rows):
        for batch in rows:
            keep = []
            for r in batch.to_pylist():
                al, ah, bl, bh = (np.frombuffer(r[c], float) for c in ("box_low", "box_high", "low", "high"))
                corners = [al * bl, al * bh, ah * bl, ah * bh]
                up, down = np.max(corners, 0).sum(), np.min(corners, 0).sum()
                slack = 1e-9 * np.abs(corners).max(initial=0) * len(al)
                meets = r["label_low"] <= r["to"] and r["from"] <= r["label_high"]
                alone = r["label_low"] == r["label_high"] == r["from"] == r["to"]
                keep.append(bool(up + slack >= r["least"] and min(down - slack, FAR) <= r["most"] and (meets if same else not alone)))
            yield batch.select(kept).filter(pa.array(keep, pa.bool_()))

    kept = ["dim", "home", "chunk", "box_low", "box_high", "label_low", "label_high", "least", "most", "node"]
    own = [c for c in kept if c != "node"]
    tops = nodes[-1].groupBy("dim").agg(F.min("node").alias("first"), F.max("node").alias("last"))
    front = batches.where("least <= most").select(*own).join(tops, "dim").select(*own, F.explode(F.sequence("first", "last")).alias("node"))
    for depth, level in enumerate(reversed(nodes)):
        if depth:
            front = front.select(*own, F.explode(F.sequence(F.col("node") * FAN, F.col("node") * FAN + FAN - 1)).alias("node"))
        level = level.select("dim", "node", F.col("box_low").alias("low"), F.col("box_high").alias("high"), F.col("label_low").alias("from"), F.col("label_high").alias("to"))
        front = front.join(level, ["dim", "node"])
        front = front.mapInArrow(test, front.select(*kept).schema)
    return front.where("node <> home").select("dim", "home", "chunk", F.col("node").alias("grp"))


def nearest(tree: DataFrame, nodes: list[DataFrame], asks: DataFrame, k: int, same: bool) -> DataFrame:
    """(own, slot, rank, vec_id, row, score): the ``k`` best rows of each of ``asks(dim, grp, own, slot, low, high)``.

    ``same`` tells whether rows of the anchor's label or all others count.
    """
    home = at_home(tree, asks, k, same)

    def elsewhere(rows):
        for batch in rows:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                anchors = np.frombuffer(r["anchors"], np.int64).reshape(-1, 2)
                x = np.frombuffer(r["asked"], float).reshape(len(anchors), r["dim"])
                ask = np.frombuffer(r["asks"], ASK)
                found = Tree(r).search(x, anchors[:, 0], anchors[:, 1], ask, np.searchsorted(anchors[:, 0], ask["own"]), k, same)
                yield pa.RecordBatch.from_pydict({"found": pa.array([found.tobytes()], pa.binary())})

    pairs = cut(descend(home, nodes, same))
    both = pairs.join(home.select("dim", "home", "chunk", "anchors", F.col("vectors").alias("asked"), "asks"), ["dim", "home", "chunk"])
    both = both.join(tree.select("dim", "grp", "ends", "rows", "vectors", "low", "high"), ["dim", "grp"])
    found = home.select("found").unionByName(both.mapInArrow(elsewhere, "found binary"))

    def rows(batches):
        for batch in batches:
            for blob in batch["found"]:
                part = np.frombuffer(blob.as_py(), FOUND)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(part[c])) for c in FOUND.names], FOUND.names)

    order = Window.partitionBy("own", "slot").orderBy(F.desc("score"), "vec_id", "row")
    found = found.mapInArrow(rows, ", ".join(f"{c} bigint" for c in FOUND.names))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(embeddings: DataFrame, group: int = GROUP, leaf: int = LEAF) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor and positive."""
    base = whole_vectors(embeddings)
    tree = pack(base, group, leaf)
    nodes = levels(tree)

    def anchors(batches):
        for batch in batches:
            for dim, grp, rows in zip(*(batch[c].to_pylist() for c in ("dim", "grp", "rows"))):
                known = np.frombuffer(rows, np.int64).reshape(-1, 3)
                known = known[known[:, 1] % ANCHORS == 0]
                yield pa.RecordBatch.from_pydict({"dim": pa.array([dim] * len(known), pa.int32()), "grp": pa.array([grp] * len(known), pa.int64()), "own": known[:, 0].copy(), "anchor_id": known[:, 1].copy()})

    chosen = cut(tree.select("dim", "grp", "rows").mapInArrow(anchors, "dim int, grp bigint, own bigint, anchor_id bigint"))
    asks = chosen.select("dim", "grp", "own", F.lit(0).cast("bigint").alias("slot"), F.lit(-FAR).alias("low"), F.lit(FAR).alias("high"))
    positives = cut(nearest(tree, nodes, asks, POSITIVES, True).select("own", F.col("rank").cast("bigint").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).join(chosen, "own"))
    # A negative score leaves no window: three tenths of it exceed nine tenths.
    windows = positives.where("positive_score >= 0").select("dim", "grp", "own", "slot", F.expr(f"({LOWEST} * positive_score + 9) DIV 10").alias("low"), F.expr(f"{HIGHEST} * positive_score DIV 10").alias("high"))
    negatives = nearest(tree, nodes, windows, NEGATIVES, False).select("own", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return negatives.join(positives, ["own", "slot"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))
