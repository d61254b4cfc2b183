"""Range joins between moments and intervals, always through an equi-key on a time bucket."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegrid.functions.timeline import (
    epoch_micros, epoch_minutes, floor_minutes, from_epoch_minutes, minute_of_day, plus_minutes)
from tidegrid.operators.chunks import CHUNK, drop_halo, with_halo
from tidegrid.operators.sizing import join_keys

DAY = 1440


def _point_bucket(ts: str, size: int) -> Column:
    return F.floor(epoch_minutes(ts) / size).alias("_bucket")


def spread_intervals(intervals: DataFrame, start: str, end: str, size: int = DAY) -> DataFrame:
    """One row per time bucket an interval touches."""
    span = F.sequence(F.floor(epoch_minutes(start) / size), F.floor(epoch_minutes(end) / size))
    return intervals.filter(F.col(start) <= F.col(end)).select("*", F.explode(span).alias("_bucket"))


def within(points: DataFrame, intervals: DataFrame, keys: Sequence[str], ts: str, start: str, end: str, *,
           closed: str = "both", how: str = "inner", size: int = DAY) -> DataFrame:
    """Pairs of a moment and every interval holding it.

    A moment lies in one bucket, so no pair appears twice. AQE splits a hot (series, bucket); no
    nested-loop join and no forced broadcast whatever the number of intervals.
    """
    low = F.col(ts) >= F.col(start) if closed in ("both", "left") else F.col(ts) > F.col(start)
    high = F.col(ts) <= F.col(end) if closed in ("both", "right") else F.col(ts) < F.col(end)
    p = points.select("*", _point_bucket(ts, size)).alias("p")
    i = spread_intervals(intervals, start, end, size).alias("i")
    equal = [*[F.col(f"p.{k}").eqNullSafe(F.col(f"i.{k}")) for k in keys], F.col("p._bucket") == F.col("i._bucket")]
    condition = equal[0]
    for e in equal[1:]:
        condition = condition & e
    joined = p.join(i, condition & low & high, how)
    if how in ("left_anti", "left_semi"):
        return joined.drop("_bucket")
    right = [F.col(f"i.{c}") for c in intervals.columns if c not in keys]
    return joined.select(*[F.col(f"p.{c}") for c in points.columns], *right)


def context_intervals(episodes: DataFrame, keys: Sequence[str], hours: int) -> DataFrame:
    """Three disjoint intervals per episode; bounds are inclusive minutes."""
    pad = hours * 60
    part = lambda regime, start, end: F.struct(F.lit(regime).alias("regime"), start.alias("from_ts"),
                                               end.alias("to_ts"))
    second = F.expr("INTERVAL '1' SECOND")
    parts = F.array(
        part("pre_event", plus_minutes("episode_start", -pad), F.col("episode_start") - second),
        part("active_event", F.col("episode_start"), F.col("episode_end")),
        part("recovery", F.col("episode_end") + second, plus_minutes("episode_end", pad)))
    return (episodes.select(*keys, "episode_id", "episode_start", F.explode(parts).alias("_p"))
            .select(*keys, "episode_id", "episode_start", "_p.regime", "_p.from_ts", "_p.to_ts"))


def attach_event_context(cells: DataFrame, episodes: DataFrame, keys: Sequence[str], hours: int = 24) -> DataFrame:
    """Regime of the origin and whether the target interval starts inside an episode.

    Overlaps are settled per distinct moment (the later episode wins), then joined back, so the
    range join sees each moment once and not once per horizon and model.
    """
    keys = list(keys)
    order = F.struct("episode_start", "episode_id")
    regimes = (within(cells.select(*keys, "origin").distinct(), context_intervals(episodes, keys, hours), keys,
                      "origin", "from_ts", "to_ts")
               .groupBy(*keys, "origin")
               .agg(F.max_by(F.struct("regime", "episode_id"), order).alias("_r"))
               .select(*keys, "origin", F.col("_r.regime").alias("origin_regime"),
                       F.col("_r.episode_id").alias("origin_episode_id")))
    plain = episodes.select(*keys, "episode_id", "episode_start", "episode_end")
    hit = (within(cells.select(*keys, "interval_start").distinct(), plain, keys, "interval_start",
                  "episode_start", "episode_end")
           .groupBy(*keys, "interval_start").agg(F.max_by("episode_id", order).alias("target_episode_id")))
    return (join_keys(join_keys(cells, regimes, [*keys, "origin"], "left"), hit, [*keys, "interval_start"], "left")
            .withColumns({
                "origin_regime": F.coalesce("origin_regime", F.lit("ordinary")),
                "origin_episode_id": F.coalesce("origin_episode_id", F.lit("")),
                "target_in_event": F.col("target_episode_id").isNotNull(),
                "target_episode_id": F.coalesce("target_episode_id", F.lit(""))}))


def next_event(points: DataFrame, events: DataFrame, keys: Sequence[str], ts: str, start: str, within_minutes: int,
               out: str = "next_start") -> DataFrame:
    """Earliest event strictly after each moment and at most ``within_minutes`` later, else NULL.

    No pairs are formed. Later minutes are answered from one row per (series, minute), read
    through a bounded range frame of halo chunks; the own minute by a window inside it. A raw log
    whose hottest key holds a third of all rows still spreads over its minutes.
    """
    keys = list(keys)
    merged = points.select(*points.columns, F.lit(None).cast("timestamp_ntz").alias("_event")).unionByName(
        events.select(*keys, F.col(start).alias(ts), F.col(start).alias("_event")), allowMissingColumns=True)
    merged = merged.withColumn("_m", epoch_minutes(ts))

    per_minute = merged.groupBy(*keys, "_m").agg(F.min("_event").alias("_first")).withColumn(
        "_minute", from_epoch_minutes(F.col("_m")))
    ahead = Window.partitionBy(*keys, CHUNK).orderBy("_m").rangeBetween(1, within_minutes)
    later = drop_halo(with_halo(per_minute, "_minute", ahead=within_minutes)
                      .withColumn("_later", F.min("_first").over(ahead))).select(*keys, "_m", "_later")

    inside = Window.partitionBy(*keys, "_m").orderBy("_s").rangeBetween(1, 60_000_000)
    found = merged.withColumn("_s", epoch_micros(ts)).withColumn("_own", F.min("_event").over(inside)).filter(
        F.col("_event").isNull())
    nearest = F.coalesce("_own", "_later")
    return (join_keys(found, later, [*keys, "_m"])
            .withColumn(out, F.when(nearest <= plus_minutes(ts, within_minutes), nearest))
            .drop("_s", "_m", "_event", "_own", "_later"))


def outside_padding(points: DataFrame, episodes: DataFrame, keys: Sequence[str], ts: str, hours: int) -> DataFrame:
    """Moments farther than the padding from every episode."""
    padded = episodes.select(*keys, plus_minutes("episode_start", -hours * 60).alias("_from"),
                             plus_minutes("episode_end", hours * 60).alias("_to"))
    return within(points, padded, keys, ts, "_from", "_to", how="left_anti")


def event_origins(episodes: DataFrame, leads: Sequence[int], keys: Sequence[str]) -> DataFrame:
    """Origins at fixed lead hours before each start, grouped for leave-episode-out."""
    lead = F.explode(F.array(*[F.lit(int(x)) for x in leads])).alias("lead_hours")
    out = episodes.select(*keys, "episode_id", "episode_start", lead)
    return out.withColumn("origin", plus_minutes("episode_start", -F.col("lead_hours") * 60)).withColumn(
        "split_group", F.col("episode_id"))


def matched_controls(origins: DataFrame, candidates: DataFrame, keys: Sequence[str], ts: str, *, near_days: int,
                     far_days: int, at_most: int, at_least: int) -> DataFrame:
    """Same-clock control moments per origin, nearest first.

    The pairing key is (series, minute of day, far_days-wide bucket): an origin meets at most one
    control per day within the wide reach, so pairs are bounded by ``2 * far_days`` per origin.
    The near reach is used when it holds enough controls, else the far one.
    """
    keys = list(keys)
    size = far_days * DAY
    o = origins.withColumn("_clock", minute_of_day("origin"))
    o = o.select("*", F.explode(F.sequence(
        F.floor((epoch_minutes("origin") - size) / size), F.floor((epoch_minutes("origin") + size) / size)))
        .alias("_bucket"))
    c = candidates.select(*keys, F.col(ts).alias("control_ts"), minute_of_day(ts).alias("_clock"),
                          F.floor(epoch_minutes(ts) / size).alias("_bucket"))
    distance = F.abs(epoch_minutes("control_ts") - epoch_minutes("origin"))
    pairs = (join_keys(o, c, [*keys, "_clock", "_bucket"]).withColumn("distance_minutes", distance)
             .filter((F.col("distance_minutes") > 0) & (F.col("distance_minutes") <= size)))
    one = Window.partitionBy(*keys, "episode_id", "lead_hours", "origin")
    near = F.col("distance_minutes") <= near_days * DAY
    pairs = pairs.withColumn("_near", F.count_if(near).over(one))
    eligible = pairs.filter(near | (F.col("_near") < at_least))
    ranked = eligible.withColumn("control_rank", F.row_number().over(one.orderBy("distance_minutes", "control_ts")))
    kept = ranked.filter(F.col("control_rank") <= at_most)
    kept = kept.withColumn("control_count", F.count(F.lit(1)).over(one))
    return kept.filter(F.col("control_count") >= at_least).drop("_clock", "_bucket", "_near")


def window_outcomes(episodes: DataFrame, labels: DataFrame, keys: Sequence[str], value: str, past_hours: int,
                    future_hours: Sequence[int]) -> DataFrame:
    """Mean, median before and mean, minimum after each episode start, in one range join."""
    keys = list(keys)
    reach = episodes.select(*keys, "episode_id", "episode_start",
                            plus_minutes("episode_start", -past_hours * 60).alias("_from"),
                            plus_minutes("episode_start", max(future_hours) * 60).alias("_to"))
    pairs = within(labels.select(*keys, "ts", value), reach, keys, "ts", "_from", "_to", closed="left")
    before = F.col("ts") < F.col("episode_start")
    y = F.col(value)
    past = F.avg(F.when(before, y))
    aggs = [past.alias("past_mean"), F.percentile(F.when(before, y), F.lit(0.5)).alias("past_median")]
    for h in future_hours:
        inside = (~before) & (F.col("ts") < plus_minutes("episode_start", h * 60))
        aggs += [F.avg(F.when(inside, y)).alias(f"future_{h}h_mean"), F.min(F.when(inside, y)).alias(f"future_{h}h_min")]
    table = pairs.groupBy(*keys, "episode_id", "episode_start").agg(*aggs)
    changes = [c for h in future_hours for c in (
        (F.col(f"future_{h}h_mean") - F.col("past_mean")).alias(f"future_{h}h_mean_change"),
        (F.col(f"future_{h}h_min") - F.col("past_mean")).alias(f"future_{h}h_min_change"))]
    return table.select("*", *changes)


def alert_detection(predictions: DataFrame, episodes: DataFrame, keys: Sequence[str], horizon_minutes: int) -> DataFrame:
    """Whether any alert fell in ``[start - h, start)``, how early, and the highest probability."""
    keys = list(keys)
    reach = episodes.select(*keys, "episode_id", "episode_start",
                            plus_minutes("episode_start", -horizon_minutes).alias("_from"))
    pairs = within(predictions, reach, keys, "origin", "_from", "episode_start", closed="left")
    alert = F.col("alert").cast("boolean")
    lead = (epoch_minutes("episode_start") - epoch_minutes("origin")) / 60.0
    found = pairs.groupBy(*keys, "episode_id").agg(
        F.count(F.lit(1)).alias("window_rows"), F.count_if(alert).alias("alert_rows"),
        F.max(F.when(alert, lead)).alias("earliest_lead_hours"), F.max("probability").alias("maximum_probability"))
    rows, hits = F.coalesce("window_rows", F.lit(0)), F.coalesce("alert_rows", F.lit(0))
    return (join_keys(episodes.select(*keys, "episode_id", "episode_start"), found, [*keys, "episode_id"], "left")
            .select(*keys, "episode_id", "episode_start", rows.alias("window_rows"), hits.alias("alert_rows"),
                    F.when(rows > 0, hits / rows).alias("alert_fraction"), (hits > 0).alias("detected"),
                    "earliest_lead_hours", "maximum_probability"))


def expand_to_fine(fine: DataFrame, coarse: DataFrame, keys: Sequence[str], ts: str, step: int,
                   horizons: Sequence[int]) -> DataFrame:
    """Forecasts of the containing coarse origin for every fine origin, at the nearest horizon.

    The horizon index of the fine origin is kept on the coarse grid: one equi-join on
    (series, coarse origin, horizon).
    """
    offset = F.explode(F.array(*[F.lit(int(h)) for h in horizons])).alias("fine_horizon")
    x = fine.select(*keys, ts, floor_minutes(ts, step).alias("origin"), offset)
    ahead = (epoch_minutes(ts) - epoch_minutes("origin") + F.col("fine_horizon")) / step
    nearest = F.least(F.round(ahead), F.lit(max(horizons) // step)) * step
    return join_keys(x.withColumn("horizon_minutes", nearest.cast("int")), coarse, [*keys, "origin", "horizon_minutes"])
