"""Session settings the library expects."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(cpus: int | str = "*", app: str = "tidegrid", **conf: str) -> SparkSession:
    """Local session for tests and benches; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TIDEGRID_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_ROOTS: dict[str, str] = {}
_STAGES: dict[tuple[str, str, str], str] = {}
_CUTS: list[str] = []
ROW_GROUP = 16 << 20


def scratch_root(spark: SparkSession) -> str:
    """Folder every executor can see: ``spark.checkpoint.dir``, a temporary one only in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.applicationId not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[context.applicationId] = tempfile.mkdtemp(prefix="spark-tidegrid-")
    return _LOCAL_ROOTS[context.applicationId]


def _files(spark: SparkSession, source: str) -> str:
    """Names, lengths and modification times of what lies in a folder and its table folders: a few dozen entries."""
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f"{s.getPath()} {s.getLen()} {s.getModificationTime()}" for s in store.listStatus(path)]
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


def stage(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A preparation stage as a written table, built once per application and state of the source's files.

    Later plans read it with column pruning and pushdown instead of repeating the scan and
    aggregation of the raw log, and a lost executor costs a re-read, not a recomputation.
    """
    key = (spark.sparkContext.applicationId, f"{source} {_files(spark, source)}", name)
    if key not in _STAGES:
        digest = hashlib.sha256(key[1].encode()).hexdigest()[:12]
        path = f"{scratch_root(spark)}/tidegrid-{key[0]}/{name}-{digest}"
        build().write.mode("overwrite").parquet(path)
        _STAGES[key] = path
    return spark.read.parquet(_STAGES[key])


def cut(df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write an intermediate table to the shared folder and go on from the file.

    Cuts the lineage for good (survives lost executors), keeps later plans short, and gives the
    optimizer the true size, so a small table is broadcast on evidence and a large one is not. A task reads
    whole row groups, so these are small: Parquet's 128 MB would lie in one task, however finely files are split.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/tidegrid-{spark.sparkContext.applicationId}/cut-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).partitionBy(*partition_by).parquet(path)
    _CUTS.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def last_cut(spark: SparkSession) -> Iterator[None]:
    """Of what is cut inside, all but the last is deleted at the end: the result, written last, needs nothing of it."""
    first = len(_CUTS)
    yield
    for path in _CUTS[first:-1]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    del _CUTS[first:]


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """What is run inside hands Python at most ``rows`` rows at a time, and reads as many from Parquet: 10,000 whole texts, Spark's default, are held several times over by each task."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = {name: spark.conf.get(name) for name in names}
    for name, value in before.items():
        spark.conf.set(name, str(min(rows, int(value)) if int(value) > 0 else rows))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
