"""Sinks: versioned tables, formatted results, append-only registry, manifests."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F


def write_version(df: DataFrame, root: str, version: str, partition_by: Sequence[str] = ()) -> str:
    """Write a new version; an existing one is never replaced."""
    path = f"{root.rstrip('/')}/{version}"
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    return path


def format_numbers(df: DataFrame, columns: Sequence[str], decimals: int) -> DataFrame:
    """Fixed-decimal text for a result file."""
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.format_string(f"%.{decimals}f", F.col(c))) for c in columns})


def write_result(df: DataFrame, path: str, columns: Sequence[str], decimals: int) -> None:
    format_numbers(df, columns, decimals).write.mode("errorifexists").option("header", True).csv(path)


def append_runs(spark: SparkSession, path: str, runs: DataFrame, key: str = "run_id") -> DataFrame:
    """Append runs to a registry; a run id already there, or twice in the batch, fails the job.

    The batch is written beside the registry first. Each of its run ids then claims a file named after it, which
    the file system creates only if it isn't there: of two writers with one id exactly one gets it, without
    a moment between a check and the append. A writer that fails gives back what it had claimed. Only then is the
    batch moved in, so readers see all of its rows or none.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    place = hadoop.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    twice = runs.groupBy(key).count().filter("count > 1")
    if not twice.isEmpty():
        raise ValueError(f"run ids repeated: {[r[0] for r in twice.limit(5).collect()]}")
    batch = uuid.uuid4().hex
    # Names that begin with an underscore are not part of the table.
    drafts, claims = hadoop.Path(place, f"_drafts/{batch}"), hadoop.Path(place, "_claims")
    runs.write.parquet(drafts.toString())
    mine = []
    try:
        # One small batch of runs: its ids are what the caller has just computed.
        for (run,) in spark.read.schema(runs.schema).parquet(drafts.toString()).select(F.col(key).cast("string")).collect():
            claim = hadoop.Path(claims, hashlib.sha256(str(run).encode()).hexdigest())
            try:
                store.create(claim, False).close()
            except Py4JJavaError as e:
                raise ValueError(f"run ids already registered: {[run]}") from e
            mine.append(claim)
        for n, status in enumerate(store.listStatus(drafts)):
            if status.getPath().getName().startswith("part-") and not store.rename(status.getPath(), hadoop.Path(place, f"part-{batch}-{n:05d}.parquet")):
                raise OSError(f"can't move {status.getPath()} into the registry")
    except BaseException:
        for claim in mine:
            store.delete(claim, False)
        raise
    finally:
        store.delete(drafts, True)
    return spark.read.schema(runs.schema).parquet(path)


def manifest(df: DataFrame, stage: str, ts: str, columns: Sequence[str], flags: Sequence[str] = ()) -> DataFrame:
    """Row count, time range, null counts and flag totals of a stage, in one aggregate."""
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
                  *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns],
                  *[F.sum(c).alias(f"{c}_total") for c in flags]).withColumn("stage", F.lit(stage))
