import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.sources import readers, sinks
from tidegrid.plans import live
from tidegrid.streaming import streams


def test_csv_encodings_are_chosen_per_file(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("name,v\n高炉,1\n".encode("utf-8"))
    (tmp_path / "b.csv").write_bytes("name,v\n焦炉,2\n".encode("gb18030"))
    rows = {r.name: (r.v, r.encoding) for r in readers.read_csv(spark, str(tmp_path), "name string, v int").collect()}
    assert rows == {"高炉": (1, "utf-8"), "焦炉": (2, "gb18030")}


def test_byte_order_mark_is_not_part_of_the_header(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbf" + "name,v\nx,1\n".encode())
    assert [tuple(r)[:2] for r in readers.read_csv(spark, str(tmp_path), "name string, v int").collect()] == [("x", 1)]


def test_versions_and_registry_refuse_repeats(spark, tmp_path):
    df = spark.createDataFrame([("r1", 1.0)], "run_id string, mape double")
    sinks.write_version(df, str(tmp_path), "v1")
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_version(df, str(tmp_path), "v1")
    path = str(tmp_path / "registry")
    assert sinks.append_runs(spark, path, df).count() == 1
    with pytest.raises(ValueError, match="r1"):
        sinks.append_runs(spark, path, df)


def test_of_two_writers_with_one_run_id_one_is_refused(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor
    path = str(tmp_path / "registry")

    def write(n):
        try:
            return sinks.append_runs(spark, path, spark.createDataFrame([(f"own{n}", float(n)), ("same", float(n))], "run_id string, mape double")) and n
        except ValueError as e:
            return str(e)

    with ThreadPoolExecutor(2) as pool:
        said = list(pool.map(write, [1, 2]))
    won = [n for n in said if isinstance(n, int)]
    assert len(won) == 1 and any("same" in str(x) for x in said)
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {(f"own{won[0]}", float(won[0])), ("same", float(won[0]))}
    lost = 3 - won[0]   # what the refused writer had claimed is free again
    assert sinks.append_runs(spark, path, spark.createDataFrame([(f"own{lost}", 0.0)], "run_id string, mape double")).count() == 3


def test_fingerprint_ignores_order_and_sees_changes(spark):
    df = spark.range(1000).withColumn("v", F.col("id") * 1.5)
    first = readers.table_fingerprint(df).first()
    assert first == readers.table_fingerprint(df.orderBy(F.desc("id")).repartition(7)).first()
    assert first != readers.table_fingerprint(df.withColumn("v", F.when(F.col("id") == 5, 0.0).otherwise(F.col("v")))).first()
    frozen = first.asDict()
    assert readers.fingerprint_matches(df, frozen).first().matches is True


def test_long_files_are_hashed_in_rounds(spark, tmp_path):
    random = np.random.default_rng(5)
    sizes = {"short": 999, "even": 3000, "a long one": 4001, "longer": 6000}
    want = set()
    for name, size in sizes.items():
        data = random.integers(0, 256, size, dtype=np.uint8).tobytes()
        (tmp_path / f"{name}.bin").write_bytes(data)
        want.add((f"{name}.bin", size, hashlib.sha256(data).hexdigest()))
    for step in (1000, 3000, 1 << 20):
        assert {tuple(r) for r in readers.file_fingerprints(spark, f"{tmp_path}/*.bin", step).collect()} == want
    assert readers.file_fingerprints(spark, f"{tmp_path}/*.bin", 1000).columns == ["file_name", "length", "sha256"]


def test_family_key(spark):
    df = spark.createDataFrame([("/x/Gas_train.csv",), ("gas-test.csv",), ("load.csv",)], "p string")
    assert [r.k for r in df.select(readers.family_key(F.col("p")).alias("k")).collect()] == ["gas", "gas", "load"]


def write_batch(spark, folder, rows, schema, n):
    """One file per micro-batch, in time order."""
    os.makedirs(folder, exist_ok=True)
    df = spark.createDataFrame(rows, schema.replace("timestamp_ntz", "string"))
    ntz = [c.split()[0] for c in schema.split(",") if c.strip().endswith("timestamp_ntz")]
    df.withColumns({c: df[c].cast("timestamp_ntz") for c in ntz}).toPandas().to_parquet(
        f"{folder}/{n:03d}.parquet", index=False, coerce_timestamps="us")
    os.utime(f"{folder}/{n:03d}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))


def read_stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_incomplete_interval_is_null_and_late_rows_are_dropped(spark, tmp_path):
    schema = "series_id string, ts timestamp_ntz, v double"
    folder = str(tmp_path / "in")
    write_batch(spark, folder, [("s", f"2025-01-01 00:{m:02d}:00", float(m)) for m in (0, 5, 10, 15)], schema, 0)
    write_batch(spark, folder, [("s", "2025-01-01 02:00:00", 1.0)], schema, 1)
    # The lateness bound of a micro-batch is the watermark of the one before.
    write_batch(spark, folder, [("s", "2025-01-01 03:00:00", 1.0)], schema, 2)
    write_batch(spark, folder, [("s", "2025-01-01 00:20:00", 99.0), ("s", "2025-01-01 05:00:00", 1.0)], schema, 3)
    out = streams.drain(spark, streams.interval_means(read_stream(spark, folder, schema), ["series_id"], "ts", "v", "15 minutes", 3, "10 minutes"))
    got = {str(r.interval_start)[11:16]: (r.samples, r["mean"]) for r in out.collect()}
    assert got == {"00:00": (3, 5.0), "00:15": (1, None), "02:00": (1, None), "03:00": (1, None)}


@pytest.mark.parametrize("batches", [[[0, 1, 2, 3, 4, 5, 6, 7, 30]], [[0, 1], [2, 3], [4, 5], [6, 7], [30]], [[1, 0], [3, 5], [2, 7], [4, 6], [30]]])
def test_fill_and_dwell_is_the_same_for_any_batches_and_order(spark, tmp_path, batches):
    schema = "series_id string, minute bigint, value double"
    values = {**dict(enumerate([5.0, None, None, None, 9.0, 9.0, None, 1.0])), 30: 1.0}
    for n, batch in enumerate(batches):
        write_batch(spark, str(tmp_path / "in"), [("s", 1000 + m, values[m]) for m in batch], schema, n)
    out = streams.drain(spark, streams.fill_and_dwell(read_stream(spark, str(tmp_path / "in"), schema), limit_minutes=2, step_minutes=1, zone_above=5.0, cap=3, delay="5 minutes"))
    rows = sorted((r.minute, r.filled, r.dwell, r.active) for r in out.collect())
    assert [r[1] for r in rows] == [5.0, 5.0, 5.0, None, 9.0, 9.0, 9.0, 1.0]
    assert [r[2] for r in rows] == [1, 2, 3, 0, 1, 2, 3, 0] and all(r[3] == 1 for r in rows)


def test_rows_behind_the_watermark_are_dropped_and_dead_series_forgotten(spark, tmp_path):
    schema = "series_id string, minute bigint, value double"
    batches = [[("dead", 0, 7.0), ("live", 0, 7.0)], [("live", 100, 7.0)], [("live", 200, None), ("dead", 5, 9.0)], [("dead", 203, None), ("live", 203, None)], [("live", 400, 1.0)], [("live", 500, 1.0)]]
    for n, batch in enumerate(batches):
        write_batch(spark, str(tmp_path / "in"), [(k, 1000 + m, v) for k, m, v in batch], schema, n)
    out = streams.drain(spark, streams.fill_and_dwell(read_stream(spark, str(tmp_path / "in"), schema), limit_minutes=1000, step_minutes=1, zone_above=5.0, cap=3, delay="5 minutes", ttl_minutes=150))
    got = {(r.series_id, r.minute - 1000): (r.filled, r.active) for r in out.collect()}
    assert ("dead", 5) not in got                      # late
    assert got["live", 203] == (7.0, 1)                # kept alive by its rows
    assert got["dead", 0] == (7.0, 1) and got["dead", 203] == (None, 0)   # its state ran out meanwhile


@pytest.mark.parametrize("batches", [[[0, 1, 2, 9]], [[0], [1], [2], [9]], [[0], [2], [1], [9]]])
def test_reconciliation_is_the_same_for_any_batches(spark, tmp_path, batches):
    schema = "series_id string, origin bigint, target bigint, prediction double"
    for n, batch in enumerate(batches):
        write_batch(spark, str(tmp_path / "in"), [("s", 1000 + o, 1000 + t, float(10 * o + t)) for o in batch for t in (3, 4)], schema, n)
    out = streams.drain(spark, streams.reconcile(read_stream(spark, str(tmp_path / "in"), schema), alpha=0.5, step_minutes=1, delay="3 minutes"))
    got = {(r.origin - 1000, r.target - 1000): r.reconciled for r in out.collect()}
    assert got == {(0, 3): 3.0, (1, 3): 8.0, (2, 3): 15.5, (0, 4): 4.0, (1, 4): 9.0, (2, 4): 16.5}



def test_a_closed_stream_emits_every_row(spark, tmp_path):
    """The newest rows are no more than the delay old, and nothing but the closing row comes after them."""
    schema = "series_id string, origin bigint, target bigint, prediction double"
    rows = [("s", 1000 + o, 1000 + o + h, float(o)) for o in range(4) for h in (1, 2, 3)]
    live.closed(spark.createDataFrame(rows, schema), ["origin", "target"], 4).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = streams.drain(spark, streams.reconcile(read_stream(spark, str(tmp_path / "in"), schema), alpha=0.5, step_minutes=1, delay="3 minutes"))
    assert sorted((r.series_id, r.origin, r.target, r.prediction) for r in out.collect()) == sorted(rows)
    assert live.closed(spark.createDataFrame([], schema), ["origin", "target"], 4).count() == 0
