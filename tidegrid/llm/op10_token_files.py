"""Token ids as ORC files: integer run-length encoding, row indexes, Bloom filters on document ids.

``write_tokens`` deals the documents out by ranges of doc_id, encodes each range in order and lets Spark's
ORC writer store it: ids as an integer list (run-length encoded), a row index every ``STRIDE`` rows and
a Bloom filter on doc_id. ``read_tokens`` reads stripes in parallel; a filter on doc_id is pushed down and
skips stripes and row groups. ``layout`` numbers the ids of all documents through the files.

Null text counts as empty (the end id alone). Null doc_ids come first; rows of equal doc_id are kept
and follow each other by text. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import uuid
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidegrid.llm import bpe
from tidegrid.llm.common import slices, table
from tidegrid.session import cut, scratch_root

END = 2
STRIDE = 2_000
OPTIONS = {"compression": "zstd", "orc.stripe.size": str(32 << 20), "orc.row.index.stride": str(STRIDE), "orc.create.index": "true",
           "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end: int = END) -> None:
    """Files of (doc_id, ordinal, ids): ascending doc_id over the files, ``ordinal`` the row's place in its file."""
    path = path or bpe.default_path()
    closing = int(end).to_bytes(4, "little")

    def run(batches):
        encode, ordinal = bpe.library(path).encode, 0
        for batch in slices(batches, "text", 1 << 20):
            ids = [encode(t or "") + closing for t in batch["text"].to_pylist()]
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
            values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
            lists = pa.ListArray.from_arrays(pa.array(ends), values)
            places = pa.array(np.arange(ordinal, ordinal + batch.num_rows))
            ordinal += batch.num_rows
            yield pa.RecordBatch.from_arrays([batch["doc_id"], places, lists], ["doc_id", "ordinal", "ids"])

    (docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
     .mapInArrow(run, "doc_id bigint, ordinal bigint, ids array<int>").write.options(**OPTIONS).orc(folder))


def read_tokens(spark: SparkSession, folder: str, only=None) -> DataFrame:
    """(file, doc_id, ordinal, ids); ``only``: a condition on doc_id, which prunes stripes and row groups."""
    rows = spark.read.schema("doc_id bigint, ordinal bigint, ids array<int>").orc(folder)
    rows = rows if only is None else rows.where(only)
    return rows.select(F.col("_metadata.file_name").alias("file"), "*")


def layout(rows: DataFrame) -> DataFrame:
    """Per document: the ids before it, its number of ids and their checksum.

    One sum per file, running sums over those few rows, and running sums within each file.
    """
    def run(batches):
        for batch in batches:
            lists = batch["ids"]
            ends = lists.offsets.to_numpy()
            data = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4")).view(np.uint8)
            sums = [crc32(data[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([batch["file"], batch["doc_id"], batch["ordinal"], pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())],
                                             ["file", "doc_id", "ordinal", "n_tokens", "ids_crc32"])

    read = cut(rows.mapInArrow(run, "file string, doc_id bigint, ordinal bigint, n_tokens bigint, ids_crc32 bigint"))
    before = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1))
    placed = read.withColumn("start", F.coalesce(before, F.lit(0)))
    # Part numbers ascend with the ranges of doc_id; as text, 100000 would come before 99999.
    number = F.regexp_extract("file", r"part-(\d+)[^/]*$", 1).try_cast("long")
    files = read.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    earlier = F.sum("total").over(Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select("file", F.coalesce(earlier, F.lit(0)).alias("base"))
    return placed.join(files, "file").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{scratch_root(spark)}/tidegrid-{spark.sparkContext.applicationId}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), folder)
    return layout(read_tokens(spark, folder))
