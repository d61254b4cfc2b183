"""Streaming forms of the batch operators: a new origin every step, late rows beyond the watermark dropped."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidegrid.functions.timeline import as_instant, as_wall_clock
from tidegrid.session import scratch_root

MINUTE = 60_000   # milliseconds
FILES = 16        # most files that one micro-batch takes in
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def open_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table as a file stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", FILES).parquet(sf_dir)


def drain(spark: SparkSession, df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over everything available into a table of the shared folder and read it back.

    File sink and checkpoint live side by side: a lost executor restarts from the last commit.
    """
    root = f"{scratch_root(spark)}/stream-{uuid.uuid4().hex}"
    # Keyed state needs the state store that spills to disk; the session's own choice comes back afterwards.
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, ROCKSDB)
    try:
        query = (df.writeStream.outputMode(mode).format("parquet").option("path", f"{root}/data")
                 .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema(df.schema).parquet(f"{root}/data")


def watermarked(stream: DataFrame, ts: str, delay: str) -> DataFrame:
    return stream.withColumn(ts, as_instant(ts)).withWatermark(ts, delay)


def interval_means(stream: DataFrame, keys: Sequence[str], ts: str, value: str, width: str, expected: int,
                   delay: str) -> DataFrame:
    """Tumbling means; an interval closed with fewer than ``expected`` samples is emitted as NULL."""
    return (watermarked(stream, ts, delay).groupBy(*keys, F.window(ts, width))
            .agg(F.count(value).alias("samples"), F.avg(value).alias("_mean"))
            .select(*keys, as_wall_clock("window.start").alias("interval_start"), "samples",
                    F.when(F.col("samples") >= expected, F.col("_mean")).alias("mean")))


def sliding_stats(stream: DataFrame, keys: Sequence[str], ts: str, value: str, width: str, slide: str, minimum: int,
                  delay: str) -> DataFrame:
    """Trailing mean and population deviation at every slide; the origin is the window end."""
    return (watermarked(stream, ts, delay).groupBy(*keys, F.window(ts, width, slide))
            .agg(F.count(value).alias("samples"), F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
            .select(*keys, as_wall_clock("window.end").alias("origin"), "samples",
                    F.when(F.col("samples") >= minimum, F.col("_m")).alias("mean"),
                    F.when(F.col("samples") >= minimum, F.col("_s")).alias("std_pop")))


def unique_rows(stream: DataFrame, keys: Sequence[str], ts: str, delay: str) -> DataFrame:
    """First row per key within the watermark."""
    return watermarked(stream, ts, delay).dropDuplicatesWithinWatermark([*keys]).withColumn(ts, as_wall_clock(ts))


def episodes(stream: DataFrame, keys: Sequence[str], ts: str, ratio: str, threshold: float, delay: str) -> DataFrame:
    """Below-threshold days as sessions: flags on neighbouring days merge, a free day splits."""
    low = stream.filter(F.col(ratio) < threshold).withColumn("_day", F.to_date(ts).cast("timestamp_ntz"))
    return (watermarked(low, "_day", delay).groupBy(*keys, F.session_window("_day", "36 hours"))
            .agg(F.min(ts).alias("episode_start"), F.max(ts).alias("episode_end"),
                 F.count(F.lit(1)).alias("flagged_points"), F.min(ratio).alias("min_ratio"))
            .drop("session_window"))


def score_matured(forecasts: DataFrame, labels: DataFrame, keys: Sequence[str], delay: str, reach: str) -> DataFrame:
    """Inner stream-stream join: a forecast is scored when the label of its target moment arrives."""
    f = watermarked(forecasts, "origin", delay).withColumn("target_ts", as_instant("target_ts")).alias("f")
    y = watermarked(labels, "label_ts", delay).alias("y")
    condition = F.expr(f"y.label_ts = f.target_ts AND y.label_ts >= f.origin AND y.label_ts <= f.origin + INTERVAL {reach}")
    for k in keys:
        condition = condition & (F.col(f"f.{k}") == F.col(f"y.{k}"))
    return f.join(y, condition).select(
        *[F.col(f"f.{k}") for k in keys], as_wall_clock("f.origin").alias("origin"),
        as_wall_clock("f.target_ts").alias("target_ts"), "f.prediction", "y.actual",
        F.abs(F.col("f.prediction") - F.col("y.actual")).alias("abs_error"))


class Ordered(StatefulProcessor):
    """Rows of a key in event-time order, whatever the order and the batches they arrive in.

    A row waits in the state until the watermark has passed its minute; timers then hand on all that is due, sorted.
    A row whose minute the watermark has passed already is late and dropped; one that repeats a key's moment
    replaces it. So the result doesn't depend on how the input was cut into batches. ``ttl`` minutes after its last
    row a key's state is given up. What is held per key is bounded by the delay, not by the length of the series.
    """

    moment: tuple[str, ...]   # key columns, the event minute first
    value: tuple[str, ...]
    columns: tuple[str, ...]  # of the output, after the series

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", ", ".join(f"{c} bigint" for c in self.moment), ", ".join(f"{c} double" for c in self.value))
        self.open()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed, first = timerValues.getCurrentWatermarkInMs(), None
        for frame in rows:
            for row in frame[[*self.moment, *self.value]].astype(object).itertuples(index=False):
                at = tuple(int(x) for x in row[: len(self.moment)])
                if at[0] * MINUTE > passed:
                    self.waiting.updateValue(at, tuple(None if x is None or x != x else float(x) for x in row[len(self.moment):]))
                    first = at[0] if first is None else min(first, at[0])
        if first is not None:
            self.handle.registerTimer(first * MINUTE)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = list(self.waiting.iterator()) if self.waiting.exists() else []
        due = sorted((tuple(at), tuple(value)) for at, value in held if at[0] * MINUTE <= passed)
        for at, _ in due:
            self.waiting.removeKey(at)
        out = [(key[0], *row) for row in self.advance(due)]
        later = [at[0] for at, _ in held if at[0] * MINUTE > passed]
        if later:
            self.handle.registerTimer(min(later) * MINUTE)
        elif (last := self.latest()) is not None:
            if (last + self.ttl) * MINUTE <= passed:
                self.forget()
            else:
                self.handle.registerTimer((last + self.ttl) * MINUTE)
        if out:
            yield pd.DataFrame(out, columns=["series_id", *self.columns])

    def close(self) -> None:
        pass


class FillAndDwell(Ordered):
    """Per series: bounded forward fill, capped dwell in a zone, ever-active flag."""

    moment, value, columns = ("minute",), ("value",), ("minute", "filled", "dwell", "active")

    def __init__(self, limit_minutes: int, step_minutes: int, zone_above: float, cap: int, ttl: int):
        super().__init__(ttl)
        self.limit, self.step, self.zone, self.cap = limit_minutes, step_minutes, zone_above, cap

    def open(self) -> None:
        self.state = self.handle.getValueState("last", "value double, minute bigint, seen bigint, dwell int, active int")

    def advance(self, due) -> list[tuple]:
        value, minute, seen, dwell, active = self.state.get() if self.state.exists() else (None, None, None, 0, 0)
        out = []
        for (m,), (v,) in due:
            if seen is not None and m - seen > self.ttl:   # given up, whether or not its timer has run
                value, minute, active = None, None, 0
            if seen is None or m - seen != self.step:
                dwell = 0
            if v is not None:
                value, minute, active = v, m, 1
            filled = value if minute is not None and m - minute <= self.limit else None
            dwell = min(dwell + 1, self.cap) if filled is not None and filled >= self.zone else 0
            seen = m
            out.append((m, filled, dwell, active))
        if out:
            self.state.update((value, minute, seen, dwell, active))
        return out

    def latest(self) -> int | None:
        return self.state.get()[2] if self.state.exists() else None

    def forget(self) -> None:
        self.state.clear()


class Reconciler(Ordered):
    """Last reconciled value per target minute of a series, forgotten once the moment has passed."""

    moment, value, columns = ("origin", "target"), ("prediction",), ("origin", "target", "prediction", "reconciled")

    def __init__(self, alpha: float, step_minutes: int, ttl: int):
        super().__init__(ttl)
        self.alpha, self.step = alpha, step_minutes

    def open(self) -> None:
        self.state = self.handle.getMapState("last", "target bigint", "origin bigint, value double")

    def advance(self, due) -> list[tuple]:
        out = []
        for (origin, target), (f,) in due:
            r = f
            if f is not None and self.state.exists() and self.state.containsKey((target,)):
                before, last = self.state.getValue((target,))
                if origin - before == self.step:
                    r = self.alpha * f + (1 - self.alpha) * last
            if r is not None:
                self.state.updateValue((target,), (origin, r))
            out.append((origin, target, f, r))
        if out:
            for (target,) in [tuple(k) for k in self.state.keys()]:
                if target <= out[-1][0]:
                    self.state.removeKey((target,))
        return out

    def latest(self) -> int | None:
        return max((k[0] for k in self.state.keys()), default=None) if self.state.exists() else None

    def forget(self) -> None:
        self.state.clear()


def _ordered(stream: DataFrame, processor: Ordered, at: str, delay: str, schema: str) -> DataFrame:
    timed = stream.withColumn("_event", F.timestamp_seconds(F.col(at) * 60)).withWatermark("_event", delay)
    return timed.groupBy("series_id").transformWithStateInPandas(processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def fill_and_dwell(stream: DataFrame, *, limit_minutes: int, step_minutes: int, zone_above: float, cap: int, delay: str = "1 hour",
                   ttl_minutes: int = 30 * 1440) -> DataFrame:
    """``stream``: series_id, minute (epoch), value. Rows up to ``delay`` behind the newest may come in any order."""
    return _ordered(stream, FillAndDwell(limit_minutes, step_minutes, zone_above, cap, ttl_minutes), "minute", delay,
                    "series_id string, minute bigint, filled double, dwell int, active int")


def reconcile(stream: DataFrame, *, alpha: float, step_minutes: int, delay: str = "1 hour", ttl_minutes: int = 1440) -> DataFrame:
    """``stream``: series_id, origin, target (epoch minutes), prediction, in event time of the origin."""
    return _ordered(stream, Reconciler(alpha, step_minutes, ttl_minutes), "origin", delay,
                    "series_id string, origin bigint, target bigint, prediction double, reconciled double")
