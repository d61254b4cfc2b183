"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import inspect
from collections.abc import Callable, Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15 | 1
PIECE = 1 << 20
_POWERS = np.ones(1, np.uint64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column) -> Column:
    """``crc32(doc_id as text) mod 5``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def fold_of(doc_id: int | None) -> int:
    return -1 if doc_id is None else crc32(str(doc_id).encode()) % 5


def give_back() -> None:
    """Memory that was freed goes back to the system; else a worker, which is used again, holds the peak of its largest task."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def tidy(run: Callable) -> Callable:
    """``run`` over a task's batches, one group or two, with ``give_back`` at its end."""
    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    def group(rows):
        try:
            return run(rows)
        finally:
            give_back()

    def pair(left, right):
        try:
            return run(left, right)
        finally:
            give_back()

    return task if inspect.isgeneratorfunction(run) else group if len(inspect.signature(run).parameters) == 1 else pair


def wrapped(docs: DataFrame, *beside: str) -> DataFrame:
    """All columns as one struct ``row``, so that no column of an operator's own clashes with them."""
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    return docs.select(F.struct(*quoted).alias("row"), *beside)


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column end to end, and where each row starts (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text; one row may be larger."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(texts_of(batch.column(batch.schema.get_field_index(text)))[1])
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit, "right"))
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def _powers(n: int) -> np.ndarray:
    """Powers of BASE and, through the odd base's inverse, of its reciprocal, modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, BASE, np.uint64))])
    return _POWERS[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def runs(body: np.ndarray, starts: np.ndarray, apart: np.ndarray = SPACE, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Lower-cases A-Z and finds the runs of bytes that are not ``apart`` in many texts at once.

    Returns where each run begins and ends, a 64-bit hash of its bytes and length, its row, and hashes of its
    first bytes for each length in ``prefixes`` (0 where it has no more). A run never goes from one text
    into the next.
    """
    n = len(body)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), none, *(np.zeros(0, np.uint64) for _ in prefixes)
    inside = ~apart[body]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = starts[1:-1][(starts[1:-1] > 0) & (starts[1:-1] < n)]
    first[edges] |= inside[edges]
    last[edges - 1] |= inside[edges - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((LOWER[body].astype(np.uint64) + np.uint64(1)) * _powers(n + 1)[n:0:-1], out=sums[1:])
    # A sum of c * BASE**(n - i) times BASE**begin is the same wherever the word stands, up to BASE**n.
    h = (sums[end] - sums[begin]) * _powers(n + 1)[begin]
    h = mixed(h * _inverse(n) + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    heads = [np.where(end - begin > k, mixed((sums[np.minimum(begin + k, n)] - sums[begin]) * _powers(n + 1)[begin] * _inverse(n) + np.uint64(k << 32)), np.uint64(0)) for k in prefixes]
    return begin, end, h, np.searchsorted(starts, begin, "right") - 1, *heads


def words(body: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and row of every word ``[^\\x20\\x09-\\x0D]+``, and each row's number of words.

    Bytes are hashed in pieces of about ``PIECE``, cut between words, so that only the words themselves take
    memory; a word's hash doesn't depend on where it stands.
    """
    parts = []
    for a, b in _word_pieces(body, starts):
        i, j = np.searchsorted(starts, a, "right") - 1, np.searchsorted(starts, b, "left")
        _, _, h, row = runs(body[a:b], np.clip(starts[i : j + 1] - a, 0, b - a))
        parts.append((h, (row + i).astype(np.int32)))
    h, row = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int32))
    return h, row, np.bincount(row, minlength=len(starts) - 1)


def _word_pieces(body: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int]]:
    a, n = 0, len(body)
    while a < n:
        b = min(a + PIECE, n)
        border = int(starts[np.searchsorted(starts, b)]) if b < n else n
        while b < border and not (gap := SPACE[body[b : b + 4096]]).any():
            b = min(b + 4096, border)
        b = min(b + int(gap.argmax()), border) if b < border else border
        yield a, b
        a = b


def _inverse(n: int) -> np.uint64:
    return np.uint64(pow(int(BASE), -int(n), 1 << 64))
