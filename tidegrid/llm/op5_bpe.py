"""BPE encoding and decoding by a bounded-lookahead streaming transducer.

``encode`` adds to every row the ids of its whole text, ``decode`` turns ids back into text. A text is
fed to ``bpe.StreamingEncoder`` in chunks, so beyond the row itself a task holds one chunk, one window
and a cache of fixed size. Both are narrow: no shuffle, and a lost task repeats only its own rows.

Null text counts as empty (no ids). Repeated rows are encoded each on its own. Other columns pass
through, except that a column named like the result is replaced. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegrid.llm import bpe
from tidegrid.llm.common import slices, table

CHUNK = 1 << 16


def _chunks(text: str) -> Iterator[str]:
    for at in range(0, len(text), CHUNK):
        yield text[at : at + CHUNK]


def encode_text(text: str, path: str) -> bytes:
    """Ids of one text as little-endian 32-bit integers."""
    encoder = bpe.StreamingEncoder(*bpe.own(path))
    return b"".join([*map(encoder.push, _chunks(text)), encoder.finish()])


def decode_ids(ids: bytes, path: str) -> Iterator[str]:
    """Text of little-endian 32-bit ids, in parts."""
    decoder = bpe.Decoder(bpe.own(path)[0])
    numbers = np.frombuffer(ids, "<u4")
    for at in range(0, len(numbers), CHUNK):
        yield decoder.push(numbers[at : at + CHUNK].tolist())
    yield decoder.finish()


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None) -> DataFrame:
    """Adds ``ids``: binary, little-endian 32-bit."""
    path = path or bpe.default_path()

    def run(batches):
        for batch in slices(batches, text):
            found = pa.array([encode_text(t or "", path) for t in batch[text].to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), found], [*kept, ids])

    kept = [c for c in docs.columns if c != ids]
    schema = docs.select(*map(_quoted, kept)).schema.add(ids, "binary")
    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, ids: str = "ids", text: str = "text", path: str | None = None) -> DataFrame:
    """Adds ``text``; null ids count as none."""
    path = path or bpe.default_path()

    def run(batches):
        for batch in batches:
            found = pa.array(["".join(decode_ids(x or b"", path)) for x in batch[ids].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), found], [*kept, text])

    kept = [c for c in rows.columns if c != text]
    return rows.mapInArrow(run, rows.select(*map(_quoted, kept)).schema.add(text, "string"))


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Digests of each document's ids and of the text that they decode to, in one pass."""
    path = path or bpe.default_path()

    def run(batches):
        for batch in slices(batches, "text"):
            out = []
            for text in batch["text"].to_pylist():
                ids, back = encode_text(text or "", path), hashlib.sha256()
                for part in decode_ids(ids, path):
                    back.update(part.encode())
                out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), back.hexdigest()))
            columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _quoted(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
