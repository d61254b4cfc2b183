"""Window features on long keyed panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.functions.timeline import epoch_minutes
from tidegrid.operators import features, fits, grid, labels as lab, reconcile, splits
from tidegrid.operators.sizing import lookup_join
from tidegrid.plans import base, events_base as ev
from tidegrid.plans.base import HOUR, KEYS, STEP, sql
from tidegrid.plans.registry import query
from tidegrid.session import cut

W = "PARTITION BY series_id ORDER BY ts"
FOLD_KEYS = ["fold_id", *KEYS]


def _rows(n: int) -> str:
    return f"({W} ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"


def _users(spark, d, feats):
    return features.build_features(base.users(spark, d), KEYS, "ts", HOUR, feats)


def _panel(spark, d, feats):
    return features.build_features(base.panel(spark, d), KEYS, "ts", HOUR, feats)


@query("e1_lags", "series_id:s, ts:t, total__lag_1:d, total__lag_24:d, total__lag_168:d",
       sql(f"""SELECT series_id, ts, lag(total, 1) OVER w AS total__lag_1, lag(total, 24) OVER w AS total__lag_24,
  lag(total, 168) OVER w AS total__lag_168 FROM users WINDOW w AS ({W})""", "users"))
def lags(spark, d):
    return _users(spark, d, [features.lag("total", k) for k in (1, 24, 168)])


@query("e2_rolling_min_fraction", "series_id:s, ts:t, total__mean_168:d, total__std_pop_168:d",
       sql(f"""SELECT series_id, ts, CASE WHEN count(total) OVER w >= 7 THEN avg(total) OVER w END AS total__mean_168,
  CASE WHEN count(total) OVER w >= 7 THEN stddev_pop(total) OVER w END AS total__std_pop_168 FROM users WINDOW w AS {_rows(167)}""", "users"))
def rolling_fraction(spark, d):
    return _users(spark, d, [features.rolling("total", 168, k, fraction=0.04) for k in ("mean", "std_pop")])


@query("e3_rolling_sample_std", "series_id:s, ts:t, total__mean_24:d, total__std_samp_24:d",
       sql(f"""SELECT series_id, ts, avg(total) OVER w AS total__mean_24, CASE WHEN count(total) OVER w >= 2 THEN stddev_samp(total) OVER w END AS total__std_samp_24
FROM users WINDOW w AS {_rows(23)}""", "users"))
def rolling_sample(spark, d):
    return _users(spark, d, [features.rolling("total", 24, "mean", 1), features.rolling("total", 24, "std_samp", 2)])


@query("e4_missing_fraction", "series_id:s, ts:t, click__missing_fraction_8:d, purchase__missing_fraction_96:d",
       sql(f"""SELECT series_id, ts, avg(CASE WHEN click IS NULL THEN 1.0 ELSE 0.0 END) OVER {_rows(7)} AS click__missing_fraction_8,
  avg(CASE WHEN purchase IS NULL THEN 1.0 ELSE 0.0 END) OVER {_rows(95)} AS purchase__missing_fraction_96 FROM panel15""", "panel15"))
def missing_share(spark, d):
    return features.build_features(base.panel(spark, d, 15), KEYS, "ts", 15,
                                   [features.missing_fraction("click", 8), features.missing_fraction("purchase", 96)])


@query("e5_differences", "series_id:s, ts:t, view__diff_1:d, view__diff_4:d, view__mean_diff_6:d",
       sql(f"""SELECT series_id, ts, d1 AS view__diff_1, d4 AS view__diff_4, avg(d1) OVER {_rows(5)} AS view__mean_diff_6
FROM (SELECT series_id, ts, view - lag(view, 1) OVER w AS d1, view - lag(view, 4) OVER w AS d4 FROM panel WINDOW w AS ({W}))""", "panel"))
def differences(spark, d):
    return _panel(spark, d, [*features.mean_difference("view", 6), features.difference("view", 4)])


@query("e6_full_window_registry", "series_id:s, ts:t, view__current:d, view__lag_1:d, view__lag_4:d, view__mean_4:d, click__mean_8:d",
       sql(f"""SELECT series_id, ts, view AS view__current, lag(view, 1) OVER w AS view__lag_1, lag(view, 4) OVER w AS view__lag_4,
  CASE WHEN count(view) OVER a = 4 THEN avg(view) OVER a END AS view__mean_4, CASE WHEN count(click) OVER b = 8 THEN avg(click) OVER b END AS click__mean_8
FROM panel WINDOW w AS ({W}), a AS {_rows(3)}, b AS {_rows(7)}""", "panel"))
def full_windows(spark, d):
    return _panel(spark, d, features.recent_lags(["view", "click"], [1, 4], [4, 8]))


@query("e7_bounded_forward_fill", "series_id:s, ts:t, total:d, filled:d",
       sql(f"SELECT series_id, ts, total, last_value(total IGNORE NULLS) OVER {_rows(4)} AS filled FROM users", "users"))
def bounded_fill(spark, d):
    return grid.forward_fill(base.users(spark, d), KEYS, "ts", ["total"], 4, HOUR, "__filled").withColumnRenamed(
        "total__filled", "filled")


@query("e8_missing_and_inserted_flags", "series_id:s, ts:t, click__missing:i, purchase__missing:i, inserted:i, boundary:i",
       sql("""SELECT series_id, ts, CASE WHEN click IS NULL THEN 1 ELSE 0 END AS click__missing,
  CASE WHEN purchase IS NULL THEN 1 ELSE 0 END AS purchase__missing, inserted,
  CASE WHEN ts = min(ts) OVER (PARTITION BY series_id) OR ts = max(ts) OVER (PARTITION BY series_id) THEN 1 ELSE 0 END AS boundary FROM panel15""", "panel15"))
def flags(spark, d):
    rows = base.panel(spark, d, 15)
    ends = rows.groupBy(*KEYS).agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"))
    return grid.missing_flags(rows, ["click", "purchase"]).join(ends, KEYS).withColumn(
        "boundary", ((F.col("ts") == F.col("_a")) | (F.col("ts") == F.col("_b"))).cast("int"))


@query("e9_ever_active", "series_id:s, ts:t, click__active:i, signup__active:i",
       sql(f"""SELECT series_id, ts, CASE WHEN count(click) OVER w > 0 THEN 1 ELSE 0 END AS click__active,
  CASE WHEN count(signup) OVER w > 0 THEN 1 ELSE 0 END AS signup__active FROM panel15 WINDOW w AS ({W} ROWS UNBOUNDED PRECEDING)""", "panel15"))
def active(spark, d):
    return grid.ever_active(base.panel(spark, d, 15), KEYS, "ts", ["click", "signup"])


@query("e10_window_delta", "series_id:s, ts:t, target_all__delta_6:d, target_all__relative_delta_6:d",
       sql(f"""SELECT series_id, ts, r - p AS target_all__delta_6, (r - p) / greatest(abs(p), 1e-9) AS target_all__relative_delta_6 FROM (
  SELECT series_id, ts, CASE WHEN count(target_all) OVER a = 6 THEN avg(target_all) OVER a END AS r,
    CASE WHEN count(target_all) OVER b = 6 THEN avg(target_all) OVER b END AS p FROM panel
  WINDOW a AS {_rows(5)}, b AS ({W} ROWS BETWEEN 11 PRECEDING AND 6 PRECEDING)) WHERE r IS NOT NULL AND p IS NOT NULL
UNION ALL SELECT series_id, ts, NULL, NULL FROM (
  SELECT series_id, ts, count(target_all) OVER a AS n, count(target_all) OVER b AS m FROM panel
  WINDOW a AS {_rows(5)}, b AS ({W} ROWS BETWEEN 11 PRECEDING AND 6 PRECEDING)) WHERE n < 6 OR m < 6""", "panel"))
def deltas(spark, d):
    return _panel(spark, d, features.window_delta("target_all", 6))


@query("e11_volatility_and_baseline", "series_id:s, ts:t, target_all__std_pop_12:d, target_all__level_vs_72:d",
       sql(f"""SELECT series_id, ts, CASE WHEN count(target_all) OVER a = 12 THEN stddev_pop(target_all) OVER a END AS target_all__std_pop_12,
  CASE WHEN count(target_all) OVER r = 4 AND count(target_all) OVER b >= 24
    THEN avg(target_all) OVER r / greatest(abs(quantile_cont(target_all, 0.5) OVER b), 1e-9) - 1.0 END AS target_all__level_vs_72
FROM panel WINDOW a AS {_rows(11)}, r AS {_rows(3)}, b AS {_rows(71)}""", "panel"))
def volatility(spark, d):
    return _panel(spark, d, [features.rolling("target_all", 12, "std_pop"),
                             features.level_vs_baseline("target_all", 4, 72, 24)])


@query("e12_low_level_ratio", "series_id:s, ts:t, smooth:d, ratio:d", sql("SELECT series_id, ts, smooth, ratio FROM ratios", "ratios"))
def low_ratio(spark, d):
    return ev.ratios(spark, d).withColumnRenamed("ratio__smooth", "smooth")


EPISODE_SPEC = ("series_id:s, episode_id:s, first_event_date:D, last_event_date:D, episode_start:t, episode_end:t, "
                "event_day_count:i, flagged_points:i, min_ratio:d, member_event_day_ids:s")


@query("e13_episodes", EPISODE_SPEC, sql("SELECT * FROM episodes", "episodes"))
def merged_episodes(spark, d):
    return ev.episodes(spark, d)


_ZONES = """SELECT *, CASE WHEN coalesce(target_all, 0) >= 150 THEN 1 ELSE 0 END AS high_zone,
  CASE WHEN coalesce(target_all, 0) <= 100 THEN 1 ELSE 0 END AS low_zone FROM panel"""
_DWELL = lambda z: (f"least(6, row_number() OVER ({W}) - coalesce(max(CASE WHEN {z} = 0 THEN rn END) OVER ({W} ROWS UNBOUNDED PRECEDING), 0))")


@query("e14_capped_dwell", "series_id:s, ts:t, high_dwell:i, low_dwell:i",
       sql(f"SELECT series_id, ts, {_DWELL('high_zone')} AS high_dwell, {_DWELL('low_zone')} AS low_dwell FROM numbered",
           "panel", zones=_ZONES, numbered=f"SELECT *, row_number() OVER ({W}) AS rn FROM zones"))
def dwell(spark, d):
    level = F.coalesce("target_all", F.lit(0.0))
    zones = base.panel(spark, d).withColumns({"high_zone": (level >= 150).cast("int"), "low_zone": (level <= 100).cast("int")})
    feats = [*features.dwell("high_zone", 6, "high_dwell"), *features.dwell("low_zone", 6, "low_dwell")]
    return features.build_features(zones, KEYS, "ts", HOUR, feats)


DELTAS = ["delta_2", "delta_6", "delta_12"]


def boundary_frame(spark, d):
    """Level, three window deltas and a balance proxy of every site hour."""
    feats = [f for k in (2, 6, 12) for f in features.window_delta("target_all", k)]
    rows = features.build_features(base.panel(spark, d), KEYS, "ts", HOUR, feats)
    return rows.select(*KEYS, "ts", F.col("target_all").alias("level"),
                       *[F.col(f"target_all__delta_{k}").alias(f"delta_{k}") for k in (2, 6, 12)],
                       (F.col("view") - F.col("purchase")).alias("balance"))


def fold_contracts(rows):
    """Reference and zone quantiles per fold and site, from hours up to the fold's train end."""
    history = splits.explode_training(rows, base.DEVELOPMENT, F.col("ts"))
    return fits.boundary_contract(history.drop("ts"), FOLD_KEYS, "level", DELTAS, "balance", reference=(0.05, 0.95), zone=(0.2, 0.8), floor=1e-6)


def pressure(spark, d):
    """Boundary pressure score of every site hour under every fold's own contract."""
    from tidegrid.operators.features import build_features
    rows = cut(boundary_frame(spark, d))
    x = lookup_join(rows, fold_contracts(rows), KEYS)
    level = F.coalesce("level", "level_median")
    x = x.withColumns({"position": (level - F.col("reference_low")) / F.col("reference_span"),
                       "low_zone": (level <= F.col("zone_low")).cast("int"),
                       "high_zone": (level >= F.col("zone_high")).cast("int")})
    x = build_features(x, FOLD_KEYS, "ts", HOUR, [*features.dwell("high_zone", 6, "high_dwell"),
                                                  *features.dwell("low_zone", 6, "low_dwell")])
    bound = lambda c: F.greatest(F.lit(-3.0), F.least(F.lit(3.0), c)) / 3.0
    speeds = [bound(F.coalesce(c, F.lit(0.0)) / F.col(f"{c}_scale")) for c in DELTAS]
    x = x.withColumns({"velocity_mean": (speeds[0] + speeds[1] + speeds[2]) / 3.0,
                       "signed_dwell": (F.col("high_dwell") - F.col("low_dwell")) / 6.0,
                       "balance_state": bound((F.coalesce("balance", "balance_median") - F.col("balance_median"))
                                              / F.col("balance_scale"))})
    centered = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("position"))) * 2.0 - 1.0
    # Weights of position, velocity, dwell and balance.
    score = centered * 0.45 + F.col("velocity_mean") * 0.25 + F.col("signed_dwell") * 0.20 + F.col("balance_state") * 0.10
    return x.withColumn("boundary_pressure_score", score)


def _qdelta(k: int) -> str:
    return (f"CASE WHEN count(target_all) OVER ({W} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) = {k} AND "
            f"count(target_all) OVER ({W} ROWS BETWEEN {2 * k - 1} PRECEDING AND {k} PRECEDING) = {k} THEN "
            f"avg(target_all) OVER ({W} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) - "
            f"avg(target_all) OVER ({W} ROWS BETWEEN {2 * k - 1} PRECEDING AND {k} PRECEDING) END AS delta_{k}")


BOUNDARY_SQL = {
    "frame": f"SELECT series_id, ts, target_all AS level, {_qdelta(2)}, {_qdelta(6)}, {_qdelta(12)}, view - purchase AS balance FROM panel",
    "contract": f"""SELECT fold_id, series_id, quantile_cont(level, 0.05) AS reference_low, quantile_cont(level, 0.2) AS zone_low, quantile_cont(level, 0.8) AS zone_high,
    quantile_cont(level, 0.95) AS reference_high, quantile_cont(level, 0.5) AS level_median, quantile_cont(balance, 0.5) AS balance_median,
    {', '.join(f"greatest(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 1e-6) AS {c}_scale" for c in ('delta_2', 'delta_6', 'delta_12', 'balance'))}
    FROM frame JOIN folds ON role = 'development' AND ts <= train_end GROUP BY 1, 2""",
    "zoned": """SELECT f.*, c.* EXCLUDE (series_id), coalesce(level, level_median) AS lev, (coalesce(level, level_median) - reference_low) / (reference_high - reference_low) AS position,
    CASE WHEN coalesce(level, level_median) <= zone_low THEN 1 ELSE 0 END AS low_zone, CASE WHEN coalesce(level, level_median) >= zone_high THEN 1 ELSE 0 END AS high_zone,
    row_number() OVER (PARTITION BY c.fold_id, f.series_id ORDER BY ts) AS rn FROM frame f JOIN contract c ON c.series_id = f.series_id""",
    "dwelt": f"SELECT *, {_DWELL('high_zone')} AS high_dwell, {_DWELL('low_zone')} AS low_dwell FROM zoned".replace(W, f"PARTITION BY fold_id, {W.removeprefix('PARTITION BY ')}"),
    "parts": """SELECT *, (high_dwell - low_dwell) / 6.0 AS signed_dwell,
    (greatest(-3.0, least(3.0, coalesce(delta_2, 0) / delta_2_scale)) / 3.0 + greatest(-3.0, least(3.0, coalesce(delta_6, 0) / delta_6_scale)) / 3.0
     + greatest(-3.0, least(3.0, coalesce(delta_12, 0) / delta_12_scale)) / 3.0) / 3.0 AS velocity_mean,
    greatest(-3.0, least(3.0, (coalesce(balance, balance_median) - balance_median) / balance_scale)) / 3.0 AS balance_state FROM dwelt""",
    "pressure": """SELECT *, (greatest(0.0, least(1.0, position)) * 2.0 - 1.0) * 0.45 + velocity_mean * 0.25 + signed_dwell * 0.20 + balance_state * 0.10
    AS boundary_pressure_score FROM parts""",
}


@query("e15_boundary_pressure", "fold_id:s, series_id:s, ts:t, position:d, low_zone:i, high_zone:i, signed_dwell:d, velocity_mean:d, balance_state:d, boundary_pressure_score:d",
       sql("SELECT * FROM pressure", "panel", "folds", **BOUNDARY_SQL))
def boundary_pressure(spark, d):
    return pressure(spark, d)


@query("a28_boundary_contract", "fold_id:s, series_id:s, reference_low:d, zone_low:d, zone_high:d, reference_high:d, level_median:d, delta_2_scale:d, delta_6_scale:d, delta_12_scale:d, balance_median:d, balance_scale:d",
       sql("SELECT * FROM contract", "panel", "folds", **{k: BOUNDARY_SQL[k] for k in ("frame", "contract")}))
def contract(spark, d):
    return fold_contracts(cut(boundary_frame(spark, d)))


@query("e16_point_labels", "series_id:s, ts:t, total__lead_1:d, total__lead_24:d",
       sql(f"SELECT series_id, ts, lead(total, 1) OVER w AS total__lead_1, lead(total, 24) OVER w AS total__lead_24 FROM users WINDOW w AS ({W})", "users"))
def leads(spark, d):
    return lab.point_labels(base.users(spark, d), KEYS, "ts", "total", [1, 24], HOUR)


@query("e17_seasonal_naive", "series_id:s, ts:t, horizon_minutes:i, seasonal:d",
       sql(f"""SELECT p.series_id, p.ts, h.horizon_minutes, s.target_all AS seasonal FROM panel p CROSS JOIN horizons h
LEFT JOIN panel s ON s.series_id = p.series_id AND s.ts = p.ts + to_minutes(CAST(h.horizon_minutes - 1440 AS BIGINT))""", "panel", "horizons"))
def seasonal_naive(spark, d):
    """Value one day before the target: a lag of (day - horizon), all horizons from one window pass."""
    feats = [features.lag("target_all", (1440 - h) // HOUR) for h in base.HORIZONS if h < 1440]
    rows = _panel(spark, d, feats)
    pick = lambda h: F.col("target_all") if h == 1440 else F.col(f"target_all__lag_{(1440 - h) // HOUR}")
    items = F.array(*[F.struct(F.lit(h).alias("horizon_minutes"), pick(h).alias("seasonal")) for h in base.HORIZONS])
    return rows.select(*KEYS, "ts", F.inline(items))


@query("e18_sequence_windows", "series_id:s, ts:t, steps:i, first_view:d, last_view:d, total_click:d",
       sql(f"""SELECT series_id, ts, 12 AS steps, first_value(view) OVER w AS first_view, view AS last_view, sum(coalesce(click, 0)) OVER w AS total_click
FROM (SELECT *, row_number() OVER ({W}) AS rn FROM panel) WINDOW w AS {_rows(11)} QUALIFY rn >= 12""", "panel"))
def sequences(spark, d):
    s = features.sequence_window(base.panel(spark, d), KEYS, "ts", ["view", "click"], 12, HOUR)
    total = F.aggregate("window_values", F.lit(0.0), lambda a, v: a + F.coalesce(v["click"], F.lit(0.0)))
    return s.select(*KEYS, "ts", F.size("window_values").alias("steps"),
                    F.element_at("window_values", 1)["view"].alias("first_view"),
                    F.element_at("window_values", -1)["view"].alias("last_view"), total.alias("total_click"))


@query("e19_previous_interval", "series_id:s, ts:t, target_part__previous_interval:d, target_all__previous_interval:d",
       sql(f"""SELECT series_id, ts, lag(target_part) OVER w AS target_part__previous_interval, lag(target_all) OVER w AS target_all__previous_interval
FROM labels WINDOW w AS ({W})""", "labels"))
def previous_interval(spark, d):
    return features.build_features(base.labels(spark, d), KEYS, "ts", STEP,
                                   [features.shifted_label(t) for t in base.TARGETS])


@query("e20_co_direction", "series_id:s, ts:t, view__click__co_direction:d",
       sql(f"""SELECT series_id, ts, avg(CASE WHEN a * b > 0 THEN 1.0 ELSE 0.0 END) OVER {_rows(15)} AS view__click__co_direction
FROM (SELECT series_id, ts, view - lag(view, 4) OVER w AS a, click - lag(click, 4) OVER w AS b FROM panel WINDOW w AS ({W}))""", "panel"))
def co_moves(spark, d):
    return _panel(spark, d, features.co_direction("view", "click", 4, 16))


@query("e21_horizon_smoothing", "model:s, series_id:s, origin:t, target:s, horizon_minutes:i, smoothed:d",
       sql("""SELECT model, series_id, origin, target, horizon_minutes, avg(prediction) OVER (PARTITION BY model, fold_id, series_id, origin, target
  ORDER BY horizon_minutes ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS smoothed FROM forecasts""", "forecasts"))
def smoothing(spark, d):
    return reconcile.smooth_horizons(base.forecasts(spark, d), ["model", "fold_id", "series_id", "origin", "target"])


@query("e22_overlap_reconciliation", "series_id:s, fold_id:s, target:s, origin:t, horizon_minutes:i, prediction:d, reconciled:d",
       "WITH RECURSIVE " + sql("""SELECT series_id, fold_id, target, origin, horizon_minutes, prediction, reconciled FROM chain""", "forecasts",
           f="""SELECT series_id, fold_id, target, origin, horizon_minutes, prediction, origin + to_minutes(CAST(horizon_minutes AS BIGINT)) AS target_ts
    FROM forecasts WHERE model = 'persistence' AND prediction IS NOT NULL""",
           linked="""SELECT f.*, p.origin IS NOT NULL AS has_previous FROM f LEFT JOIN f p ON p.series_id = f.series_id AND p.fold_id = f.fold_id AND p.target = f.target
    AND p.target_ts = f.target_ts AND p.origin = f.origin - INTERVAL '240 minutes'""",
           chain="""SELECT series_id, fold_id, target, origin, horizon_minutes, target_ts, prediction, prediction AS reconciled FROM linked WHERE NOT has_previous
    UNION ALL SELECT l.series_id, l.fold_id, l.target, l.origin, l.horizon_minutes, l.target_ts, l.prediction, 0.7 * l.prediction + 0.3 * c.reconciled
    FROM linked l JOIN chain c ON c.series_id = l.series_id AND c.fold_id = l.fold_id AND c.target = l.target AND c.target_ts = l.target_ts
      AND l.origin = c.origin + INTERVAL '240 minutes'""").removeprefix("WITH "))
def overlap(spark, d):
    f = base.forecasts(spark, d).filter("model = 'persistence' AND prediction IS NOT NULL")
    return reconcile.overlap_reconcile(f, [*KEYS, "fold_id", "target"], 0.7, STEP)


@query("e23_recent_origins", "series_id:s, ts:t, target_all:d",
       sql("""SELECT series_id, ts, target_all FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS rn FROM labels) WHERE rn <= 42""", "labels"))
def recent(spark, d):
    return splits.recent_window(base.labels(spark, d), KEYS, "ts", 42, STEP)


@query("p7_minutes_between_steps", "series_id:s, steps:i, span_minutes:i",
       sql("SELECT series_id, count(*) AS steps, (epoch(max(ts)) - epoch(min(ts))) // 60 AS span_minutes FROM users GROUP BY 1", "users"))
def spans(spark, d):
    return base.users(spark, d).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("steps"),
                                                   (F.max(epoch_minutes("ts")) - F.min(epoch_minutes("ts"))).alias("span_minutes"))
