"""Size-aware heavy-light Jaccard join of word n-gram sets.

A document's set holds the hashes of its distinct five-word shingles. Documents of equal sets form a class,
and only classes are joined. All sets are ordered the same way, rare shingles first: by the logarithm of
their document frequency, from a sketch of fixed size over all documents, and then by hash. Two sets with
a Jaccard similarity of 0.75 or more share an element among the first ``n // 4 + 1`` of each, and share
two among the first ``n // 4 + 2``.

* Light sets, up to a boundary size, are found by enumerating all pairs (subsets of fixed size two) of those.
* Heavy sets scan the inverted lists of the single elements; light sets that are close enough in size to a
  heavy one are listed as well.
* The boundary is that of least cost, from the number of sets of each size and the mean list length.

Both kinds of key are dealt over buckets of bounded size. To lose no link without emitting all pairs of
a list, entries carry a bound: if a list's key is the first that two sets share, what follows it in the shorter
rest is all that they can share besides. Sets that agree on a common passage alone meet far back in their order, where
little is left, and drop out of its lists by size. Every similar pair keeps the list of its first shared key.
Each list then compares its members with one leader. Members that are then in one component need no
further comparison. Where a list still holds several components, the members outside its largest one meet
a few of the others, those still outside 32 times as many, and so on until what is left has met all the others: copies
around the limit find one of the many they resemble long before all pairs are formed. Candidates are pruned by an exact bound (cell counts of both sets bound their
overlap) and then verified on the whole sets. Lists are joined by Spark, so a list held by a third of all
rows is a skewed join and never one task's memory.

Null texts and texts without words have no set and link with nothing. Fewer than five words are one
shingle. Rows with a null doc_id take part; a component's id is its smallest id that is not null. Repeated
rows are of one class. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidegrid.llm.common import mixed, slices, table, texts_of, tidy, words, wrapped
from tidegrid.llm.components import components
from tidegrid.session import cut, small_batches

N, SIMILARITY = 5, 75
SLOTS, PARTS = 1 << 24, 16
CELLS = 64
BUCKET = 400_000
REACH = 64  # others that a member meets in the first round
BLOOM = 1 << 26  # bits
NO_ID = -(1 << 62)
_STEPS = [np.uint64(pow(0xA24BAED4963EE407, k, 1 << 64)) for k in range(1, N + 1)]
ENTRY = np.dtype([("key", "<u4"), ("size", "<u4"), ("far", "<u4"), ("set", "<i8")])


def shingle_sets(column, n: int = N):
    """Each row's sorted distinct shingle hashes."""
    h, _, counts = words(*texts_of(column))
    ends = np.cumsum(counts)
    whole = np.zeros(max(len(h) - n + 1, 0), np.uint64)
    for k in range(n):
        whole += h[k : k + len(whole)] * _STEPS[k]
    whole = mixed(whole)
    for c, end in zip(counts.tolist(), ends.tolist()):
        if c >= n:
            yield np.unique(whole[end - c : end - n + 1])
        elif c:
            yield mixed(np.array([sum(int(x) * int(s) for x, s in zip(h[end - c : end], _STEPS)) + c & (1 << 64) - 1], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def set_id(v: np.ndarray) -> int:
    """A 64-bit hash of a whole set."""
    return int(mixed(mixed(v).sum(keepdims=True) + np.uint64(len(v)))[0].view(np.int64))


def cells(v: np.ndarray) -> bytes:
    """How many elements fall into each cell; about two to a cell, a power of two of cells."""
    n = max(CELLS, 1 << max(len(v) // 2, 1).bit_length())
    found = np.bincount((v & np.uint64(n - 1)).astype(np.int64), minlength=n)
    kind = np.uint8 if found.max() < 256 else np.uint32
    return bytes([kind().itemsize]) + found.astype(kind).tobytes()


def overlap_bound(x: bytes, y: bytes) -> int:
    """No two sets with these cells have more elements in common."""
    x, y = (np.frombuffer(c, np.uint8 if c[0] == 1 else np.uint32, offset=1).astype(np.int64) for c in (x, y))
    n = min(len(x), len(y))
    return int(np.minimum(x.reshape(-1, n).sum(0), y.reshape(-1, n).sum(0)).sum())


def describe(docs: DataFrame) -> DataFrame:
    """One row per document (doc_id, set, n, cells), and rows (part, counts) of the frequency sketch."""
    names = ["doc_id", "set", "n", "cells", "part", "counts"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]

    def run(batches):
        sketch = np.zeros(SLOTS, np.uint8)  # what a task counts ends at 255
        for batch in slices(batches, "text"):
            sets = list(shingle_sets(batch["text"]))
            met, times = np.unique(np.concatenate([_slot(v).astype(np.int32) for v in sets]), return_counts=True)
            sketch[met] = np.minimum(sketch[met] + times, 255)
            rows = [(set_id(v), len(v), cells(v)) if len(v) else (None, 0, None) for v in sets]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, t) for c, t in zip(zip(*rows), types[1:4])), pa.nulls(len(rows), types[4]), pa.nulls(len(rows), types[5])], names)
        for part, counts in enumerate(sketch.reshape(PARTS, -1)):
            if counts.any():
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in types[:4]), pa.array([part], types[4]), pa.array([zlib.compress(counts.tobytes(), 1)])], names)

    return cut(docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id bigint, set bigint, n bigint, cells binary, part int, counts binary"))


def _slot(v: np.ndarray) -> np.ndarray:
    return (v >> np.uint64(36)).astype(np.int64) & (SLOTS - 1)


def ranks(described: DataFrame) -> np.ndarray:
    """Eight times the binary logarithm of the document frequency in each of the sketch's slots; 16 MB at any size.

    A task's own count ends at 255; what is that frequent is last in any order.
    """
    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(SLOTS // PARTS, np.int64)
        for c in group["counts"]:
            total += np.frombuffer(zlib.decompress(c.as_py()), np.uint8)
        steps = np.minimum(8 * np.log2(total + 1), 255).astype(np.uint8)
        return pa.table({"part": group["part"][:1], "counts": [zlib.compress(steps.tobytes(), 1)]})

    out = np.zeros((PARTS, SLOTS // PARTS), np.uint8)
    for row in described.where("part IS NOT NULL").select("part", "counts").groupBy("part").applyInArrow(tidy(add), "part int, counts binary").collect():
        out[row["part"]] = np.frombuffer(zlib.decompress(row["counts"]), np.uint8)
    return out.ravel()


def scan_length(rank: np.ndarray) -> float:
    """Other members that an entry of the rarest quarter meets in its list, beyond what chance puts into a slot."""
    slots = np.bincount(rank, minlength=256)
    counts = 2.0 ** (np.arange(256) / 8) - 1
    mass = np.cumsum(slots * counts)
    rare = mass <= max(mass[-1] / 4, counts[np.argmax(mass > 0)])
    rare[np.argmax(mass > 0)] = True
    return float(max(0.0, (slots * counts**2)[rare].sum() / max((slots * counts)[rare].sum(), 1e-9) - mass[-1] / SLOTS))


def boundary(sizes: list[tuple[int, int]], scan: float) -> int:
    """The largest light size, of least cost: pairs to enumerate against entries and members to scan."""
    best, at, light = None, 0, 0.0
    heavy = lambda n: (n // 4 + 1) * (1 + scan)
    rest = sum(c * heavy(n) for n, c in sizes)
    near = 0.0  # light sets within reach of a heavy one are listed too
    for n, c in [(0, 0), *sorted(sizes)]:
        p = n // 4 + 2
        light += c * p * (p - 1) / 2
        rest -= c * heavy(n)
        near = sum(k * heavy(m) for m, k in sizes if 3 * n < 4 * m <= 4 * n) if p < 40 else float("inf")
        if best is None or light + rest + near < best:
            best, at = light + rest + near, n
    return at


def entries(docs: DataFrame, rank: np.ndarray, light: int, buckets: int) -> DataFrame:
    """(bucket, single, entries): keys of every set, in packed arrays."""
    shared = docs.sparkSession.sparkContext.broadcast(zlib.compress(rank.tobytes(), 1))

    def run(batches):
        order, done = np.frombuffer(zlib.decompress(shared.value), np.uint8), set()
        for batch in slices(batches, "text"):
            keys, sets, sizes, ones, fars = [], [], [], [], []
            for v in shingle_sets(batch["text"]):
                n = len(v)
                if n < 2 or (own := set_id(v)) in done:
                    continue
                done.add(own)
                p = n // 4 + 1
                first = v[np.argsort(order[_slot(v)], kind="stable")[: p + 1]]
                parts = []
                if n <= light:
                    i, j = np.triu_indices(len(first), 1)
                    low, high = np.minimum(first[i], first[j]), np.maximum(first[i], first[j])
                    parts.append((mixed(low * _STEPS[0] + high), n - j + 1, False))
                if 4 * n > 3 * light:
                    parts.append((first[:p], n - np.arange(p), True))
                for k, far, single in parts:
                    keys.append(k), fars.append(far), sets.append(np.full(len(k), own)), sizes.append(np.full(len(k), n)), ones.append(np.full(len(k), single))
            if not keys:
                continue
            key, single = np.concatenate(keys), np.concatenate(ones)
            packed = np.empty(len(key), ENTRY)
            packed["key"], packed["size"], packed["set"] = (key >> np.uint64(32)).astype(np.uint32), np.concatenate(sizes), np.concatenate(sets)
            packed["far"] = np.concatenate(fars)
            place = (key % np.uint64(buckets)).astype(np.int64) * 2 + single
            by = np.argsort(place, kind="stable")
            place, packed = place[by], packed[by]
            starts = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1, [len(place)]])
            blobs = [packed[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:])]
            at = place[starts[:-1]]
            yield pa.RecordBatch.from_arrays([pa.array((at // 2).astype(np.int32)), pa.array(at % 2 == 1), pa.array(blobs, pa.binary())], ["bucket", "single", "entries"])

    return docs.select("text").mapInArrow(tidy(run), "bucket int, single boolean, entries binary")


def lists(dealt: DataFrame, light: int) -> DataFrame:
    """Rows (a, b): a leader and a member of the same list; rows (list, set, size, far, single): lists of three or more."""
    schema = "a bigint, b bigint, list bigint, set bigint, size bigint, far bigint, single boolean"

    def run(group: pa.Table) -> pa.Table:
        single = group["single"][0].as_py()
        rows = np.frombuffer(b"".join(group["entries"].to_pylist()), ENTRY)
        # The leader comes first; of a set that is listed twice, the entry that allows more.
        rows = rows[np.lexsort((-rows["far"].astype(np.int64), rows["set"], mixed(np.ascontiguousarray(rows["set"]).view(np.uint64)), rows["key"]))]
        keep = np.ones(len(rows), bool)
        keep[1:] = (rows["key"][1:] != rows["key"][:-1]) | (rows["set"][1:] != rows["set"][:-1])
        rows = _partnered(_partnered(rows[keep]))
        if not len(rows):
            return pa.table({n: pa.nulls(0, t) for n, t in zip(("a", "b", "list", "set", "size", "far", "single"), [*[pa.int64()] * 6, pa.bool_()])})
        first = np.concatenate([[True], rows["key"][1:] != rows["key"][:-1]])
        starts = np.flatnonzero(first)
        number = np.cumsum(first) - 1
        count = np.diff(np.concatenate([starts, [len(rows)]]))
        leader = starts[number]
        able = ~first & _able(rows["size"], rows["size"][leader], single, light) & _reach(rows["size"], rows["far"], rows["size"][leader], rows["far"][leader])
        pairs = np.unique(np.stack([rows["set"][leader][able], rows["set"][able]], 1), axis=0)
        more = (count >= 3)[number]
        mark = np.zeros(len(starts), np.uint64)
        np.add.at(mark, number, mixed(rows["set"].view(np.uint64) + np.uint64(single)))
        met, once, same = np.unique(mark, return_index=True, return_inverse=True)
        # Of lists with the same members only one is given on, with the most that any of them allows.
        order = np.lexsort((-rows["far"].astype(np.int64), rows["set"], same[number]))
        start = np.ones(len(rows), bool)
        start[1:] = (same[number[order[1:]]] != same[number[order[:-1]]]) | (rows["set"][order[1:]] != rows["set"][order[:-1]])
        most = np.empty(len(rows), np.int64)
        most[order] = rows["far"][order[start]][np.cumsum(start) - 1]
        fresh = np.zeros(len(starts), bool)
        fresh[once] = True
        more &= fresh[number]
        n, m = len(pairs), int(more.sum())
        none = lambda k, t: pa.nulls(k, t)
        big = pa.int64()
        join = lambda x, y: pa.chunked_array([x, y])
        return pa.table({"a": join(pa.array(pairs[:, 0]), none(m, big)), "b": join(pa.array(pairs[:, 1]), none(m, big)),
                         "list": join(none(n, big), pa.array(mark[number][more].view(np.int64))), "set": join(none(n, big), pa.array(rows["set"][more])),
                         "size": join(none(n, big), pa.array(rows["size"][more].astype(np.int64))), "far": join(none(n, big), pa.array(most[more])), "single": join(none(n, pa.bool_()), pa.array(np.full(m, single)))})

    return cut(dealt.groupBy("bucket", "single").applyInArrow(tidy(run), schema))


def _able(x, y, single: bool, light: int):
    """Sizes that allow the similarity; among singles, at least one heavy set (the others meet by pairs)."""
    x, y = x.astype(np.int64), y.astype(np.int64)
    able = 100 * np.minimum(x, y) >= SIMILARITY * np.maximum(x, y)
    return able & (np.maximum(x, y) > light) if single else able


def _reach(x, far_x, y, far_y):
    """Whether two sets can be similar enough if their list's key is the first they share: ``far`` bounds the overlap."""
    return (100 + SIMILARITY) * np.minimum(far_x, far_y).astype(np.int64) >= SIMILARITY * (x.astype(np.int64) + y)


def _partnered(rows: np.ndarray) -> np.ndarray:
    """Entries (by key) without those that no size in their list suits.

    An entry allows partners of at most ``most`` elements; it needs one that small, and one that allows its own size.
    """
    if not len(rows):
        return rows
    starts = np.flatnonzero(np.concatenate([[True], rows["key"][1:] != rows["key"][:-1]]))
    count = np.diff(np.concatenate([starts, [len(rows)]]))
    size = rows["size"].astype(np.int64)
    most = (100 + SIMILARITY) * rows["far"].astype(np.int64) // SIMILARITY - size
    least, widest = np.repeat(np.minimum.reduceat(size, starts), count), np.repeat(np.maximum.reduceat(most, starts), count)
    return rows[(least <= most) & (size <= widest) & np.repeat(count > 1, count)]


def _needed(a: int, b: int) -> int:
    """The least overlap of sets of ``a`` and ``b`` elements that are similar enough."""
    return -(-SIMILARITY * (a + b) // (100 + SIMILARITY))


def _sets(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(set, items) of the classes ``wanted(set, first_id)``, and of few others."""
    shared = docs.sparkSession.sparkContext.broadcast(zlib.compress(_bloom(wanted), 1))

    def read(batches):
        bits = np.frombuffer(zlib.decompress(shared.value), np.uint8)
        for batch in slices(batches, "text"):
            sets = list(shingle_sets(batch["text"]))
            own = np.array([set_id(v) if len(v) > 1 else 0 for v in sets], np.int64)
            at = _bits(own, batch["doc_id"].fill_null(NO_ID).to_numpy())
            asked = (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(0)
            found = [(int(own[i]), sets[i].tobytes()) for i in np.flatnonzero(asked) if len(sets[i]) > 1]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.binary()))], ["set", "items"])

    # Only the first document of a class gives its set.
    return cut(docs.select("doc_id", "text").mapInArrow(tidy(read), "set bigint, items binary"))


def verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, known: DataFrame | None = None, sets: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Exactly those of ``pairs(a, b)`` that are similar enough and join components, with the links ``known`` so far; all components.

    ``sets`` holds what the pairs need, if it was read before; those few pairs are compared at once.
    """
    left, right = (classes.select(F.col("set").alias(x), F.col("n").alias(f"n_{x}"), F.col("cells").alias(f"cells_{x}")) for x in "ab")

    def bound(batches):
        for batch in batches:
            keep = [overlap_bound(x, y) >= _needed(n, m) for n, x, m, y in zip(*(batch[c].to_pylist() for c in ("n_a", "cells_a", "n_b", "cells_b")))]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    likely = cut(pairs.join(left, "a").join(right, "b").mapInArrow(tidy(bound), "a bigint, b bigint"))
    sets_read = sets is not None
    if not sets_read:
        ends = likely.select(F.col("a").alias("set")).union(likely.select("b")).distinct()
        sets = _sets(ends.join(classes, "set").select("set", "first_id"), docs)

    def compare(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch["items_a"].to_pylist(), batch["items_b"].to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= SIMILARITY * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def exact(some: DataFrame) -> DataFrame:
        left, right = (sets.select(F.col("set").alias(x), F.col("items").alias(f"items_{x}")) for x in "ab")
        if sets_read:  # for more pairs than these
            left, right = left.join(some, "a", "left_semi"), right.join(some, "b", "left_semi")
        # A member's set goes to its leader's.
        return cut(some.join(right, "b").select("a", "b", "items_b").join(left, "a").select("a", "b", "items_a", "items_b").mapInArrow(tidy(compare), "a bigint, b bigint"))

    if sets_read:
        links = cut(known.unionByName(exact(likely)))
        return links, cut(components(links))
    # Each member meets one leader first; then what is in one component needs no more comparison.
    best = cut(likely.groupBy("b").agg(F.min_by("a", F.xxhash64("a")).alias("a")))
    links = exact(best)
    links = links if known is None else known.unionByName(links)
    parts = cut(components(links))
    rest = likely.join(best, ["a", "b"], "left_anti")
    for x in "ab":
        rest = rest.join(parts.select(F.col("id").alias(x), F.col("component").alias(f"c_{x}")), x, "left")
    rest = cut(rest.where("coalesce(c_a, a) <> coalesce(c_b, b)").select("a", "b"))
    if rest.isEmpty():
        return links, parts
    more = exact(rest)
    return (links, parts) if more.isEmpty() else (both := links.unionByName(more), cut(components(both)))


def _bits(sets: np.ndarray, ids: np.ndarray) -> np.ndarray:
    h = mixed(sets.view(np.uint64) ^ mixed(ids.astype(np.int64).view(np.uint64)))
    return np.stack([(h >> np.uint64(s)) % np.uint64(BLOOM) for s in (0, 13, 26, 38)]).astype(np.int64)


def _bloom(ids: DataFrame) -> bytes:
    """A filter of fixed size over (set, first_id): what it lets through in error is only joined in vain."""
    def part(batches):
        bits = np.zeros(BLOOM // 8, np.uint8)
        for batch in batches:
            at = _bits(batch["set"].to_numpy(), batch["first_id"].fill_null(NO_ID).to_numpy()).ravel()
            np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        yield pa.RecordBatch.from_pydict({"bits": [zlib.compress(bits.tobytes(), 1)]})

    out = np.zeros(BLOOM // 8, np.uint8)
    def fold(batches):
        both = np.zeros(BLOOM // 8, np.uint8)
        for batch in batches:
            for b in batch["bits"].to_pylist():
                both |= np.frombuffer(zlib.decompress(b), np.uint8)
        yield pa.RecordBatch.from_pydict({"bits": [zlib.compress(both.tobytes(), 1)]})

    partial = ids.mapInArrow(tidy(part), "bits binary").repartition(8).mapInArrow(tidy(fold), "bits binary")
    for (bits,) in partial.collect():
        out |= np.frombuffer(zlib.decompress(bits), np.uint8)
    return out.tobytes()


def divided(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """``rows(list, set, size, single, far)`` of the lists that hold several components so far, with their component."""
    rows = rows.join(parts.select(F.col("id").alias("set"), "component"), "set", "left").withColumn("component", F.coalesce("component", "set"))
    mixed_lists = rows.groupBy("list").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("list")
    return cut(rows.join(mixed_lists, "list"))


def remaining(rows: DataFrame, light: int, reach: int, done: DataFrame) -> DataFrame:
    """Pairs (a, b) of one of the ``divided`` lists that are in different components and aren't ``done``: about ``reach``
    for each member outside the list's largest component, and all of them in lists that are no longer than that.
    """
    shares = rows.groupBy("list", "component").agg(F.count("*").alias("c"))
    main = shares.groupBy("list").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.sum("c").alias("n"))
    # A power of two of parts: what met in one part is in one part again when there are fewer.
    main = main.select("list", "main", F.expr(f"shiftleft(1L, CAST(ceil(log2(greatest(n / {reach}.0D, 1D))) AS INT))").alias("parts"))
    rows = rows.join(main, "list")
    odd = rows.where("component <> main").select("list", F.col("set").alias("x"), F.col("size").alias("nx"), F.col("far").alias("fx"), F.col("component").alias("cx"), "main",
                                                 F.pmod(F.xxhash64("set", "list"), "parts").alias("part"))
    both = odd.join(rows.select("list", "single", F.col("set").alias("y"), F.col("size").alias("ny"), F.col("far").alias("fy"), F.col("component").alias("cy"),
                                F.pmod(F.xxhash64("set"), "parts").alias("part")), ["list", "part"])
    # Two that are both outside the largest component meet once.
    both = both.where("cx <> cy AND (cy = main OR x < y)")
    both = both.where(f"{100 + SIMILARITY} * least(fx, fy) >= {SIMILARITY} * (nx + ny)")
    both = both.where(f"100 * least(nx, ny) >= {SIMILARITY} * greatest(nx, ny) AND (NOT single OR greatest(nx, ny) > {light})")
    return cut(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(done, ["a", "b"], "left_anti"))


def connected(found: DataFrame, links: DataFrame, parts: DataFrame, classes: DataFrame, docs: DataFrame, light: int) -> DataFrame:
    """All components, from the ``links`` and components (``parts``) that the comparisons with leaders left."""
    done = found.where("a IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rows = found.where("list IS NOT NULL").groupBy("list", "set", "size", "single").agg(F.max("far").alias("far"))
    sets, reach = None, REACH
    while True:
        held = divided(rows, parts)
        most = held.groupBy("list").count().agg(F.max("count")).first()[0]
        if most is None:
            return parts
        rest = remaining(held, light, reach, done)
        if not rest.isEmpty():
            if sets is None:
                sets = _sets(held.select("set").distinct().join(classes, "set").select("set", "first_id"), docs)
            links, parts = verify(rest, classes, docs, links, sets)
            done = done.unionByName(rest)
        if most <= reach:
            return parts
        rows, reach = held.drop("component"), 32 * reach


def groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, set, n) of all documents and (set, component, component_id) of all sets."""
    with small_batches(docs.sparkSession):
        return _groups(docs)


def _groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    described = describe(docs)
    rank = ranks(described)
    rows = described.where("part IS NULL")
    classes = cut(rows.where("set IS NOT NULL").groupBy("set", "n").agg(F.first("cells").alias("cells"), F.min("doc_id").alias("first_id")))
    # One row for each size that occurs, whatever the number of documents.
    sizes = [(r["n"], r["c"]) for r in classes.where("n > 1").groupBy("n").agg(F.count("*").alias("c")).collect()]
    light = boundary(sizes, scan_length(rank))
    total = sum(c * ((n // 4 + 2) * (n // 4 + 1) // 2 if n <= light else n // 4 + 1) for n, c in sizes)
    found = lists(entries(docs, rank, light, max(64, total // BUCKET)), light)
    links, parts = verify(cut(found.where("a IS NOT NULL").select("a", "b").distinct()), classes, docs)
    parts = connected(found, links, parts, classes, docs, light)
    known = classes.select("set", "first_id").join(parts.select(F.col("id").alias("set"), "component"), "set", "left").withColumn("component", F.coalesce("component", "set"))
    least = known.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return rows.select("doc_id", "set", "n"), cut(known.join(least, "component").select("set", "component", "component_id"))


def join_near(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    rows, known = groups(docs)
    out = rows.withColumnRenamed("n", "n_shingles").join(known, "set", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that have the smallest doc_id of their component, and all that have no set.

    Repeated rows of it are kept once. A row without doc_id stays only if its component has no id at
    all, one for each such component, or if it has no set.
    """
    rows, known = groups(docs)
    kept = rows.join(known, "set", "left").where("doc_id = component_id OR set IS NULL AND doc_id IS NOT NULL").select("doc_id").distinct()
    named = docs.join(kept.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])

    def add(batches):
        for batch in slices(batches, "text"):
            sets = pa.array([set_id(v) if len(v) else None for v in shingle_sets(batch["text"])], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["row"], sets], ["row", "set"])

    unnamed = wrapped(docs.where("doc_id IS NULL"), "text")
    with small_batches(docs.sparkSession):
        unnamed = cut(unnamed.mapInArrow(tidy(add), T.StructType([unnamed.schema["row"], T.StructField("set", T.LongType())])))
    unnamed = unnamed.join(known, "set", "left")
    empty = unnamed.where("set IS NULL").select("row.*")
    unnamed = unnamed.where("set IS NOT NULL AND component_id IS NULL").dropDuplicates(["component"]).select("row.*")
    return named.unionByName(empty).unionByName(unnamed)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_near(table(spark, sf_dir, "documents"))
