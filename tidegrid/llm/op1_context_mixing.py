"""Language-model scores by online logistic mixing of context bit predictors.

A text is its words without case, one space between words and an end sign. Every byte is coded by a Huffman
code of the training text, and every bit of the code is predicted: three predictors look up how often the bit
was 1 after the last 3 and 5 bytes and after the beginning of the word. Their log-odds are summed with
weights; the weights, a set for each degree of confidence of two predictors (the gate), are corrected after
each bit along the text. The score is the sum over all bits of log10 of the chance given to the bit that came.

Counts are rows that grow with the training text, one for each context and byte that follows it. Contexts of
3 and 5 bytes are kept in full, words as hashes of 55 bits, so contexts never add up in one place. Every slice
of texts sends its distinct rows to shards by hash, which add them up over all slices and reply to each slice
the log-odds of its own rows; a slice's texts are scored where its replies meet them. Weights start anew every
``LANE`` bytes of a text, so that long texts advance in parallel; contexts go on.

The base is the add-half unigram score. Tokens are counted by the same shards: a slice sends each of its
distinct tokens once, with a count, so no shard holds the occurrences of a hot word.

Null and empty texts are the end sign alone. A null doc_id trains. Repeated rows count each. Extra columns
are ignored. An empty table gives no rows; without training texts every chance is a half.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegrid.llm.common import BASE, LOWER, SPACE, _inverse, _powers, fold_of, mixed, runs, slices, table, texts_of
from tidegrid.session import cut, small_batches

BITS = 22  # of a table given to score_texts
TABLES, TOKENS = 3, 3
SLICE, PIECE, TOGETHER = 12 << 20, 1 << 20, 6 << 20
LANE, BLOCK = 1024, 64
GATES, RATE, START, PRIOR = 4, 0.02, 0.4, 0.1
STEP = 12.0  # steps of a table's log-odds
END, BLANK = 10, 32


# Texts as bytes, contexts and bits.

def stream(body: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts as words with one blank between and an end sign each, and where each begins (the last: the end)."""
    rows = len(starts) - 1
    firsts = starts + np.arange(rows + 1)
    raw = np.full(len(body) + rows, BLANK, np.uint8)
    place = np.ones(len(raw), bool)
    place[firsts[1:] - 1] = False
    raw[place] = LOWER[body]
    inside = ~SPACE[raw]
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    keep[firsts[:-1]] = inside[firsts[:-1]]
    sums = np.concatenate([[0], np.cumsum(keep)])
    none = sums[firsts[1:]] == sums[firsts[:-1]]
    keep[firsts[1:][none] - 1] = True
    sums = np.concatenate([[0], np.cumsum(keep)])
    out = np.where(inside, raw, BLANK)[keep].astype(np.uint8)
    begin = sums[firsts]
    out[begin[1:] - 1] = END
    return out, begin


def contexts(x: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """What stands before each byte in its text, for each table: 3 bytes, 5 bytes, 55 bits of the word so far."""
    n = len(x)
    last = []
    for k in range(1, 6):
        shifted = np.empty(n, np.uint32)
        shifted[k:] = x[: max(n - k, 0)]
        shifted[:k] = END
        for j in range(k):  # nothing of the text before
            own = begin[:-1] + j
            shifted[own[own < begin[1:]]] = END
        last.append(shifted)
    o3 = last[0] | last[1] << np.uint32(8) | last[2] << np.uint32(16)
    o5 = (o3 | last[3] << np.uint32(24)).astype(np.uint64) | last[4].astype(np.uint64) << np.uint64(32)
    # The word so far begins after the last blank: a difference of running sums of its bytes, brought to one scale.
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * _powers(n + 1)[n:0:-1], out=sums[1:])
    starts = np.flatnonzero((last[0] == BLANK) | (last[0] == END))
    lengths = np.diff(np.concatenate([starts, [n]]))
    word = (sums[:-1] - np.repeat(sums[starts], lengths)) * np.repeat(_powers(n + 1)[starts] * _inverse(n), lengths)
    return np.stack([o3.astype(np.uint64), o5, mixed(word) >> np.uint64(9)])


class Code:
    """A Huffman code of byte counts: for each byte its bits and the inner nodes they leave."""

    def __init__(self, counts: np.ndarray):
        heap = [(int(c) + 1, b, b) for b, c in enumerate(counts)]
        heapq.heapify(heap)
        children: dict[int, tuple[int, int]] = {}
        while len(heap) > 1:
            (m, _, left), (n, _, right) = heapq.heappop(heap), heapq.heappop(heap)
            children[256 + len(children)] = (left, right)
            heapq.heappush(heap, (m + n, 255 + len(children), 255 + len(children)))
        paths: dict[int, list[tuple[int, int]]] = {}
        open_ = [(heap[0][2], [])]
        while open_:
            node, path = open_.pop()
            if node < 256:
                paths[node] = path
            else:
                open_ += [(child, [*path, (node - 256, bit)]) for bit, child in enumerate(children[node])]
        self.lengths = np.array([len(paths[b]) for b in range(256)], np.int32)
        self.first = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int32)
        flat = [step for b in range(256) for step in paths[b]]
        spread = np.random.default_rng(3).permutation(1 << 16)[:256]
        # Twice the node's offset in the tables, and the bit.
        self.steps = np.array([2 * spread[node] + bit for node, bit in flat], np.int32)

    def expand(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``steps`` of all bits of all bytes, and each byte's number of bits."""
        lengths = self.lengths[x]
        ends = np.cumsum(lengths, dtype=np.int32)
        at = np.repeat(self.first[x] - (ends - lengths), lengths)
        at += np.arange(len(at), dtype=np.int32)
        return self.steps.take(at), lengths


def slots(context: np.ndarray, steps: np.ndarray, lengths: np.ndarray, bits: int) -> np.ndarray:
    """Places in a table of ``1 << bits``."""
    out = np.repeat(context, lengths)
    out += steps
    out &= (1 << bits) - 1
    return out


# Scores against the finished tables.

def score_texts(body: np.ndarray, starts: np.ndarray, code: Code, tables: np.ndarray) -> np.ndarray:
    """log10 of the chance of each text by tables of ``1 << BITS`` log-odds."""
    x, begin = stream(body, starts)
    context = contexts(x, begin) & np.uint64((1 << BITS) - 1)
    steps, lengths = code.expand(x)
    return mix_texts([tables[k].take(slots(context[k].astype(np.int64), steps >> 1, lengths, BITS)) for k in range(TABLES)], begin, steps, lengths)


def mix_texts(inputs: list[np.ndarray], begin: np.ndarray, steps: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 of the chance of each text from the predictors' log-odds of all its bits."""
    return mix_pieces([([*inputs, (steps & 1).astype(np.int8)], lanes(begin, lengths))])


def lanes(begin: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of at most LANE bytes of one text: its number, the first bit and the number of bits."""
    first = np.concatenate([[0], np.cumsum(lengths)])
    sizes = np.diff(begin)
    many = -(-sizes // LANE)
    row = np.repeat(np.arange(len(sizes)), many)
    number = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    left = begin[row] + number * LANE
    start, end = first[left], first[np.minimum(left + LANE, begin[row + 1])]
    return row, start, end - start


def mix_pieces(held: list[tuple[list[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]]) -> np.ndarray:
    """log10 of the chance of each text of several pieces, whose lanes advance together; ``held`` (the predictors' log-odds and
    the bits; the lanes) is emptied.
    """
    rows, starts, sizes, texts, bits = [], [], [], 0, 0
    for values, (row, start, size) in held:
        rows.append(row + texts), starts.append(start + bits), sizes.append(size)
        texts += int(row[-1]) + 1
        bits += len(values[-1])
    columns = [list(c) for c in zip(*(values for values, _ in held))]
    held.clear()
    padded = []
    while columns:
        padded.append(np.concatenate([*columns.pop(0), np.zeros(BLOCK, np.int8)]))
    costs = _mix(padded, np.concatenate(starts), np.concatenate(sizes))
    return np.bincount(np.concatenate(rows), costs, texts) / -np.log(10)


def _mix(values: list[np.ndarray], start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Nats that each lane costs, from the predictors' log-odds and the bits; ``BLOCK`` more of them than lanes reach."""
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    n = len(start)
    reach = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")  # lanes that are that long
    # The weights of a gate and lane lie together, so that one place is read and written for all predictors.
    weights = np.full((GATES * n, 4), START, np.float32).view(np.complex128).ravel()
    cost = np.zeros(n)
    own, cell, lane, room = np.empty(n, np.complex128), np.empty(n, np.intp), np.arange(n), np.empty((2, n), np.float32)
    w = own.view(np.float32).reshape(-1, 4)
    views = [np.lib.stride_tricks.sliding_window_view(v, BLOCK) for v in values]
    for at in range(0, int(size[0]), BLOCK):
        steps = min(BLOCK, int(size[0]) - at)
        m = reach[at]
        *raw, came = (np.ascontiguousarray(v[start[:m] + at].T[:steps]) for v in views)
        gate = (np.abs(raw[-1]) > 2 * STEP).view(np.int8) + 2 * (np.abs(raw[-2]) > 2 * STEP).view(np.int8)
        stretch = [r.astype(np.float32) * np.float32(1 / STEP) for r in raw]
        came = came.astype(np.float32)
        chance = np.full((steps, m), 0.5, np.float32)
        for s in range(steps):
            k = reach[at + s]
            c, miss, part = cell[:k], *room[:, :k]
            np.multiply(gate[s, :k], n, out=c, dtype=np.intp)
            c += lane[:k]
            weights.take(c, out=own[:k], mode="clip")
            ins = [x[s, :k] for x in stretch]
            p = np.multiply(w[:k, 0], ins[0], out=chance[s, :k])
            for i in range(1, TABLES):
                p += np.multiply(w[:k, i], ins[i], out=part)
            np.negative(p, out=p)
            np.exp(p, out=p)
            p += 1
            np.divide(1, p, out=p)
            np.subtract(came[s, :k], p, out=miss)
            miss *= np.float32(RATE)
            for i in range(TABLES):
                w[:k, i] += np.multiply(miss, ins[i], out=part)
            weights[c] = own[:k]
        live = at + np.arange(steps)[:, None] < size[:m]
        paid = np.log(np.maximum(np.abs(chance + (came - 1)), np.float32(1e-7)))
        cost[:m] -= np.where(live, paid, 0).sum(0, dtype=np.float64)
    out = np.empty(n)
    out[order] = cost
    return out


# What is gathered from the training texts.

def _trains(ids: list[int | None]) -> np.ndarray:
    return np.array([fold_of(i) != 1 for i in ids], bool)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their counts added up."""
    keys, counts = (np.concatenate(c) for c in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, all first bytes first."""
    return zlib.compress(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1), dtype=np.uint64)


def distinct(body: np.ndarray, starts: np.ndarray, trains: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """The distinct keys of each table and of the tokens with their training counts, and the training texts' byte counts."""
    histogram, found = np.zeros(256, np.int64), [[] for _ in range(TABLES + 1)]
    for a, b in _pieces(starts):
        own, begins = body[starts[a] : starts[b]], starts[a : b + 1] - starts[a]
        x, begin = stream(own, begins)
        train = np.repeat(trains[a:b], np.diff(begin))
        histogram += np.bincount(x[train], minlength=256)
        tail = (x.astype(np.uint64) << np.uint64(1)) | train
        for k, context in enumerate(contexts(x, begin)):
            keys, n = np.unique(context << np.uint64(9) | tail, return_counts=True)
            found[k].append((keys >> np.uint64(1), np.where(keys & np.uint64(1), n, 0)))
        _, _, h, row = runs(own, begins)
        keys, at = np.unique(h, return_inverse=True)
        found[TOKENS].append((keys, np.bincount(at, trains[a:b][row], len(keys)).astype(np.int64)))
    return [_merge(parts) for parts in found], histogram


def distinct_keys(body: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """The keys of ``distinct`` without counts."""
    found = [[] for _ in range(TABLES + 1)]
    for a, b in _pieces(starts):
        own, begins = body[starts[a] : starts[b]], starts[a : b + 1] - starts[a]
        x, begin = stream(own, begins)
        for k, context in enumerate(contexts(x, begin)):
            found[k].append(_once(context << np.uint64(8) | x))
        found[TOKENS].append(_once(runs(own, begins)[2]))
    return [_once(np.concatenate(parts)) for parts in found]


def _once(keys: np.ndarray) -> np.ndarray:
    """Distinct keys in order; ``keys`` is sorted in its place."""
    keys.sort()
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]]


def dealt(keys: np.ndarray, kind: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys by shard, and where each shard's begin in it."""
    shard = (mixed((keys if kind == TOKENS else keys >> np.uint64(8)) + np.uint64(kind)) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


class Index:
    """Places of distinct keys, by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.mask = np.uint64((1 << max(4, int(2 * len(keys)).bit_length())) - 1)
        self.at = np.full(int(self.mask) + 1, -1, np.int32)
        left, slot = np.arange(len(keys), dtype=np.int32), (mixed(keys) & self.mask).astype(np.int64)
        while len(left):
            free = self.at[slot] < 0
            self.at[slot[free]] = left[free]
            lost = self.at[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & int(self.mask)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Every key must be there."""
        slot = (mixed(keys) & self.mask).astype(np.int64)
        out = self.at[slot]
        wrong = np.flatnonzero(self.keys[out] != keys)
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & int(self.mask)
            out[wrong] = self.at[slot[wrong]]
            wrong = wrong[self.keys[out[wrong]] != keys[wrong]]
        return out


def _pieces(starts: np.ndarray) -> list[tuple[int, int]]:
    """Runs of whole texts of about ``PIECE`` bytes."""
    out, a = [], 0
    while a < len(starts) - 1:
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + PIECE, "right")) - 1)
        out.append((a, b))
        a = b
    return out


KEPT = "slice bigint, bytes binary, body binary, starts binary, ids array<bigint>"
GATHERED = "slice bigint, shard int, kind int, keys binary, counts binary"


def keep(docs: DataFrame) -> DataFrame:
    """Each slice's texts and the byte counts of those that train; written, as slices must stay what they are."""
    names, types = [c.split()[0] for c in KEPT.split(", ")], [pa.int64(), *[pa.binary()] * 3, pa.list_(pa.int64())]

    def run(batches):
        number, codec = TaskContext.get().partitionId() << 32, pa.Codec("zstd", compression_level=9)
        for batch in _joined(batches):
            body, starts = texts_of(batch["text"])
            ids, histogram = batch["doc_id"].to_pylist(), np.zeros(256, np.int64)
            trains = _trains(ids)
            for a, b in _pieces(starts):
                x, begin = stream(body[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
                histogram += np.bincount(x[np.repeat(trains[a:b], np.diff(begin))], minlength=256)
            row = (number, histogram.tobytes(), codec.compress(body.tobytes(), asbytes=True), zlib.compress(starts.astype(np.int64).tobytes(), 1), ids)
            number += 1
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, types)], names)

    return cut(docs.select("doc_id", "text").mapInArrow(run, KEPT))


def _texts(body: pa.Scalar, starts: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """The texts of a kept slice, and where each begins."""
    starts = np.frombuffer(zlib.decompress(starts.as_buffer()), np.int64)
    return np.frombuffer(pa.decompress(body.as_buffer(), int(starts[-1]), "zstd", asbytes=True) if starts[-1] else b"", np.uint8), starts


def gather(kept: DataFrame, shards: int) -> DataFrame:
    """Per slice and shard the distinct rows of each table and the tokens, with training counts."""
    names = [c.split()[0] for c in GATHERED.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]

    def run(batches):
        for batch in batches:
            for number, ids, *texts in zip(batch["slice"].to_pylist(), batch["ids"], batch["body"], batch["starts"]):
                columns = []
                for k, (keys, n) in enumerate(distinct(*_texts(*texts), _trains(ids.as_py()))[0]):
                    order, ends = dealt(keys, k, shards)
                    for s in np.flatnonzero(np.diff(ends)):
                        mine = order[ends[s] : ends[s + 1]]
                        columns.append((number, int(s), k, _packed(keys[mine]), zlib.compress(n[mine].astype(np.int32).tobytes(), 1)))
                if columns:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*columns), types)], names)

    return kept.select("slice", "ids", "body", "starts").mapInArrow(run, GATHERED)


def _joined(batches):
    """The same rows in batches of about ``SLICE`` bytes of text."""
    held, size = [], 0
    for batch in slices(batches, "text", SLICE // 4):
        held.append(batch)
        size += batch["text"].nbytes
        if size >= SLICE:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def odds(pairs: np.ndarray, counts: np.ndarray, code: Code) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds, in steps, of all bits of each (context, byte) of one shard, and where each pair's begin (the last: the end)."""
    steps, lengths = code.expand((pairs & np.uint64(255)).astype(np.uint8))
    context = np.cumsum(np.diff(pairs >> np.uint64(8), prepend=pairs[:1] >> np.uint64(8)) > 0)
    node, at = np.unique(np.repeat(context, lengths) << 17 | steps >> 1, return_inverse=True)
    n = np.repeat(counts, lengths)
    ones = np.bincount(at, n * (steps & 1), len(node))
    zeros = np.bincount(at, n, len(node)) - ones
    found = np.clip(np.round(STEP * np.log((ones + PRIOR) / (zeros + PRIOR))), -127, 127).astype(np.int8)
    return found[at], np.concatenate([[0], np.cumsum(lengths)])


REPLY = "slice bigint, kind int, shard int, found binary, total bigint, distinct bigint"


def replies_of(gathered: DataFrame, code: Code) -> DataFrame:
    """To each slice, in the order of its own rows, their log-odds or, for tokens, counts over all training texts."""
    shared = gathered.sparkSession.sparkContext.broadcast(code)

    def shard(group: pa.Table) -> pa.Table:
        rows, out = group.to_pylist(), []
        for kind in sorted({r["kind"] for r in rows}):
            own = [r for r in rows if r["kind"] == kind]
            asked = [_unpacked(r["keys"]) for r in own]
            keys, counts = _merge([(k, np.frombuffer(zlib.decompress(r["counts"]), np.int32).astype(np.int64)) for k, r in zip(asked, own)])
            if kind == TOKENS:
                out.append((None, None, None, None, int(counts.sum()), int((counts > 0).sum())))
            else:
                flat, first = odds(keys, counts, shared.value)
            for r, k in zip(own, asked):
                at = np.searchsorted(keys, k)
                if kind == TOKENS:
                    found = counts[at]
                else:
                    size = first[at + 1] - first[at]
                    found = flat[np.repeat(first[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
                out.append((r["slice"], kind, r["shard"], zlib.compress(found.astype(np.int64 if kind == TOKENS else np.int8).tobytes(), 1), None, None))
        types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
        return pa.table({n.split()[0]: pa.array(x, t) for n, x, t in zip(REPLY.split(", "), zip(*out), types)})

    return cut(gathered.groupBy("shard").applyInArrow(shard, REPLY))


SCORED = "doc_id bigint, held_out boolean, words bigint, hits bigint, sums double, score double, bytes bigint"


def score_slices(kept: DataFrame, replies: DataFrame, code: Code, shards: int) -> DataFrame:
    """``SCORED`` of every text, where its slice meets the replies."""
    shared = kept.sparkSession.sparkContext.broadcast(code)

    def run(group: pa.Table) -> pa.Table:
        code, own = shared.value, group.filter(pc.is_valid(group["body"]))
        body, starts = _texts(own["body"][0], own["starts"][0])
        ids = own["ids"][0].as_py()
        index, found, first = [], [], []
        for kind, keys in enumerate(distinct_keys(body, starts)):
            # Texts give the same rows again, so replies need not carry them.
            keys = keys[dealt(keys, kind, shards)[0]]
            index.append(Index(keys))
            form = np.int64 if kind == TOKENS else np.int8
            replies = group.filter(pc.equal(group["kind"], kind)).select(["shard", "found"]).sort_by("shard")["found"]
            found.append(np.concatenate([np.zeros(0, form), *(np.frombuffer(zlib.decompress(f.as_buffer()), form) for f in replies)]))
            first.append(np.concatenate([[0], np.cumsum(code.lengths[(keys & np.uint64(255)).astype(np.int64)])]).astype(np.int32))
        out, held, scores = [], [], []
        for a, b in _pieces(starts):
            own, begins = body[starts[a] : starts[b]], starts[a : b + 1] - starts[a]
            x, begin = stream(own, begins)
            steps, lengths = code.expand(x)
            within = np.arange(len(steps), dtype=np.int32) - np.repeat(np.cumsum(lengths, dtype=np.int32) - lengths, lengths)
            inputs = [found[k].take(np.repeat(first[k][index[k].find(c << np.uint64(8) | x)], lengths) + within) for k, c in enumerate(contexts(x, begin))]
            _, _, h, row = runs(own, begins)
            known = found[TOKENS][index[TOKENS].find(h)] if len(h) else np.zeros(0, np.int64)
            n = b - a
            out.append((np.bincount(row, minlength=n), np.bincount(row, known > 0, n).astype(np.int64), np.bincount(row, np.log10(known + 0.5), n).astype(float), np.diff(begin)))
            held.append(([*inputs, (steps & 1).astype(np.int8)], lanes(begin, lengths)))
            # Pieces are mixed together: the more lanes advance at once, the less a step costs each.
            if b == len(starts) - 1 or sum(len(v[-1]) for v, _ in held) >= 4 * TOGETHER:
                scores.append(mix_pieces(held))
        words, hits, sums, sizes = (np.concatenate(c) for c in zip(*out))
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "held_out": pa.array([fold_of(i) == 1 for i in ids]), "words": words.astype(np.int64), "hits": hits, "sums": sums, "score": np.concatenate(scores), "bytes": sizes.astype(np.int64)})

    own = kept.select("slice", "body", "starts", "ids")
    both = own.unionByName(replies.where("slice IS NOT NULL").select("slice", "kind", "shard", "found"), allowMissingColumns=True)
    return both.groupBy("slice").applyInArrow(run, SCORED)


def score(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits, bytes, bits_per_byte) of every document; the bytes are those scored, the end sign included."""
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    shards = shards or max(32, 4 * docs.rdd.getNumPartitions())
    with small_batches(docs.sparkSession):
        kept = keep(docs)
    # A few hundred bytes for each slice of texts, added up before they come here.
    def add(batches):
        total = np.zeros(256, np.int64)
        for batch in batches:
            for b in batch["bytes"].to_pylist():
                total += np.frombuffer(b, np.int64)
        yield pa.RecordBatch.from_pydict({"bytes": [total.tobytes()]})

    histogram = sum((np.frombuffer(r["bytes"], np.int64) for r in kept.select("bytes").mapInArrow(add, "bytes binary").collect()), np.zeros(256, np.int64))
    code = Code(histogram)
    # Rows go straight to their shards: written too, they would lie on disk twice.
    replies = replies_of(gather(kept, shards), code)
    whole = replies.agg(F.sum("total").alias("n"), F.sum("distinct").alias("v")).first()
    ends = int(histogram[END])  # each training text has one end
    n, kinds = (whole["n"] or 0) + ends, (whole["v"] or 0) + (ends > 0)
    tokens = F.col("words") + 1
    total = float(np.log10(n + 0.5 * (kinds + 1)))
    bits = F.col("score") * -float(np.log2(10))
    return score_slices(kept, replies, code, shards).select(
        "doc_id", "held_out", tokens.alias("n_tokens"), (F.col("hits") + int(ends > 0)).alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("sums") + float(np.log10(ends + 0.5)) - tokens * total).alias("base_score"), "score", bits.alias("bits"), "bytes", (bits / F.col("bytes")).alias("bits_per_byte"))


def op1_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
