"""Scans: Parquet with pruning, CSV with an encoding ladder, fingerprints."""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tidegrid.session import cut

# Encodings tried in this order.
ENCODINGS = ("utf-8", "gb18030", "gbk")
STEP_BYTES = 256 << 20   # of a file that one task hashes
PART_BYTES = 4 << 20
STATE_BYTES = 128        # room for OpenSSL's SHA256_CTX
BOM = "﻿"


def table(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def time_slice(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Inclusive time range as a plain filter, so it reaches the Parquet reader."""
    return df.filter(F.col(ts).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def file_encodings(spark: SparkSession, path: str) -> DataFrame:
    """Which encoding each file needs, decided on its bytes by the executors.

    The CSV reader replaces bad UTF-8 silently, so validity is tested before parsing.
    """
    raw = spark.read.format("binaryFile").load(path)
    text_ok = F.is_valid_utf8(F.col("content").cast("string"))
    return raw.select("path", F.when(text_ok, ENCODINGS[0]).otherwise(ENCODINGS[1]).alias("encoding"), "length")


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV files of mixed encodings as one table, with the encoding each row came from.

    At most one scan per encoding in the ladder. The file listing is metadata, like Spark's own.
    """
    groups: dict[str, list[str]] = {}
    for row in file_encodings(spark, path).select("path", "encoding").collect():
        groups.setdefault(row.encoding, []).append(row.path)
    if not groups:
        raise FileNotFoundError(path)
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    out = None
    for encoding, files in sorted(groups.items()):
        part = (spark.read.schema(schema).option("header", True).option("encoding", encoding)
                .option("enforceSchema", True).csv(files).withColumn("encoding", F.lit(encoding)))
        out = part if out is None else out.unionByName(part)
    return out


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Order-free content fingerprint: row count, exact sum and xor of row hashes; map-side combined."""
    cells = [F.coalesce(F.to_json(F.col(c)) if dict(df.dtypes)[c].startswith(("array", "struct", "map"))
                        else F.col(c).cast("string"), F.lit("\u0000")) for c in sorted(df.columns)]
    h = F.xxhash64(*cells)
    return df.select(h.alias("_h")).agg(
        F.count(F.lit(1)).alias("row_count"), F.sum(F.col("_h").cast("decimal(38,0)")).cast("string").alias("hash_sum"),
        F.bit_xor("_h").alias("hash_xor"))


def fingerprint_matches(df: DataFrame, frozen: dict[str, object]) -> DataFrame:
    out = table_fingerprint(df)
    same = F.lit(True)
    for name, value in frozen.items():
        same = same & (F.col(name) == F.lit(value))
    return out.withColumn("matches", same)


def file_fingerprints(spark: SparkSession, path: str, step: int = STEP_BYTES) -> DataFrame:
    """SHA-256 of the bytes of each file.

    The hash is a chain over a file's bytes. Files longer than ``step`` are read ``step`` bytes a round, each round by a
    task that starts from the state that the one before left: 112 bytes a file. Where Python doesn't reach the store, or
    without OpenSSL's library, only whole files can be read.
    """
    files = spark.read.format("binaryFile").load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name")
    # The listing alone: no file is opened.
    long = files.filter(F.col("length") > step).select("path", "length")
    most = long.agg(F.max("length"), F.min("path")).first()
    if most[0] is None or not _opens(most[1]):
        return files.select(name, "length", F.sha2("content", 256).alias("sha256"))
    rest, done = cut(long.select("path", "length", F.lit(None).cast("binary").alias("state"))), []
    for start in range(0, most[0], step):
        rest = cut(_hashed(rest, start, step))
        done.append(rest.filter("sha256 IS NOT NULL").select(name, "length", "sha256"))
        rest = rest.filter("sha256 IS NULL").drop("sha256")
    short = files.filter(F.col("length") <= step).select(name, "length", F.sha2("content", 256).alias("sha256"))
    return reduce(DataFrame.unionByName, done, short)


def _hashed(files: DataFrame, start: int, step: int) -> DataFrame:
    """``files(path, length, state)`` after the bytes from ``start`` on, ``step`` at most; ``sha256`` of those that end there."""
    def run(batches):
        import pyarrow as pa
        crypto = _crypto()
        for batch in batches:
            out = []
            for path, length, state in zip(*(batch[c].to_pylist() for c in ("path", "length", "state"))):
                held = ctypes.create_string_buffer(state or b"", STATE_BYTES)
                if state is None:
                    crypto.SHA256_Init(held)
                end, at = min(start + step, length), start
                with _open(path) as file:
                    file.seek(start)
                    while at < end:
                        part = file.read(min(end - at, PART_BYTES))
                        if not part:
                            raise OSError(f"{path} is shorter than its {length} bytes were")
                        crypto.SHA256_Update(held, part, ctypes.c_size_t(len(part)))
                        at += len(part)
                digest = ctypes.create_string_buffer(32)
                if end == length:
                    crypto.SHA256_Final(digest, held)
                out.append((path, length, held.raw, digest.raw.hex() if end == length else None))
            yield pa.RecordBatch.from_pydict({n: pa.array(c, t) for n, c, t in zip(("path", "length", "state", "sha256"), zip(*out) if out else [[]] * 4,
                                                                               (pa.string(), pa.int64(), pa.binary(), pa.string()))})

    # One file a task: few rows, many bytes each.
    count = files.count()
    spread = files.repartitionByRange(max(1, count), "path") if count > 1 else files
    return spread.mapInArrow(run, "path string, length bigint, state binary, sha256 string")


def _crypto() -> ctypes.CDLL:
    """OpenSSL, which Python's own hashes come from; unlike hashlib it shows its state, a plain C struct."""
    return ctypes.CDLL(ctypes.util.find_library("crypto") or "libcrypto.so.3")


def _open(path: str):
    from pyarrow import fs
    if path.startswith("file:"):
        return open("/" + path[5:].lstrip("/"), "rb")
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def _opens(path: str) -> bool:
    try:
        _crypto().SHA256_Init
        _open(path).close()
    except (OSError, ValueError, AttributeError):
        return False
    return True


def family_key(path: Column) -> Column:
    """Source family from a file name: directory, extension and a train/test suffix removed."""
    stem = F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.[A-Za-z0-9]+$", "")
    return F.lower(F.regexp_replace(stem, r"(?i)[_-](train|test)(ing)?$", ""))
