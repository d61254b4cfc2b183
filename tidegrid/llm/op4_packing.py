"""Cost-balanced packing of whole documents into training sequences.

The cost of a run of n tokens of one document is estimated as ``LINEAR * n + QUADRATIC * n * n``:
attention is masked between documents. Documents are taken by descending cost; each goes to the
sequence of lowest cost that still has room for it. Runs of a whole sequence fill an empty one. When
no sequence has room for all of a document, it is cut: the cheapest sequence with any capacity left
takes what fits, and the rest is assigned again by its own cost.

A block of about ``BLOCK_TOKENS`` tokens is packed at a time, inside the task that encoded it, so nothing
is shuffled and a task holds one block; only the last sequence of a block is padded. A block's number of
sequences is the least that holds its tokens. A lost task repeats its own blocks and gives the same ids.

Null text counts as empty (the end id alone). Rows repeat as they come; a null doc_id stays null. Extra
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tidegrid.llm import bpe
from tidegrid.llm.common import slices, table, tidy

CAPACITY = 1024
END = 0
# An attention layer of width 1024: the feed-forward work of a token against that of a pair of tokens.
LINEAR, QUADRATIC = 12 * 1024, 1
BLOCK_TOKENS = 2 << 20
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, cost double"


def cost(n):
    return LINEAR * n + QUADRATIC * n * n


def assign(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one block of documents."""
    total = sum(lengths)
    n = -(-total // capacity)
    out: list[tuple[int, int, int, int, int]] = []
    left: list[tuple[int, int, int]] = []  # by descending length, and so by descending cost
    sequence = 0
    for doc, length in enumerate(lengths):
        for at in range(0, length - capacity + 1, capacity):
            out.append((doc, at, capacity, sequence, 0))
            sequence += 1
        if length % capacity:
            left.append((-(length % capacity), doc, length - length % capacity))
    heapq.heapify(left)
    spent, room = np.zeros(n - sequence), np.full(n - sequence, capacity)
    while left:
        length, doc, at = heapq.heappop(left)
        length = -length
        open_ = np.where(room >= length, spent, np.inf)
        i = int(np.argmin(open_))
        if open_[i] == np.inf:
            i = int(np.argmin(np.where(room > 0, spent, np.inf)))
            heapq.heappush(left, (int(room[i]) - length, doc, at + int(room[i])))
            length = int(room[i])
        out.append((doc, at, length, sequence + i, capacity - int(room[i])))
        spent[i] += cost(length)
        room[i] -= length
    return out


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece."""
    path = path or bpe.default_path()
    closing = int(end).to_bytes(4, "little")

    def run(batches):
        encode = bpe.library(path).encode
        base = TaskContext.get().partitionId() << 40
        ids: list[bytes] = []
        keys: list[int | None] = []
        held = 0

        def packed():
            nonlocal base, held
            found = assign([len(x) // 4 for x in ids], capacity)
            rows = [(keys[d], at, n, crc32(memoryview(ids[d])[4 * at : 4 * (at + n)]), len(ids[d]) // 4, base + s, o, float(cost(n))) for d, at, n, s, o in found]
            base += max(s for _, _, _, s, _ in found) + 1
            ids.clear(), keys.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 7 + [pa.float64()])], NAMES)

        for batch in slices(batches, "text"):
            for key, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                ids.append(encode(text or "") + closing)
                keys.append(key)
                held += len(ids[-1]) // 4
                if held >= block_tokens:
                    yield packed()
        if ids:
            yield packed()

    return docs.select("doc_id", "text").mapInArrow(tidy(run), SCHEMA)


NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def op4_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
