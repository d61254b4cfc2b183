"""Model fitting and scoring as Spark jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.functions import blend
from tidegrid.functions.horizons import expand_horizons, interval_start
from tidegrid.functions.timeline import on_grid, plus_minutes
from tidegrid.operators import features, fits, metrics, reconcile, splits, trees
from tidegrid.operators.compare import union_forecasts
from tidegrid.operators.sizing import join_keys, lookup_join
from tidegrid.plans import base
from tidegrid.plans.base import DEVELOPMENT, HORIZONS, HOUR, KEYS, STEP, STRICT, STRICT_SPEC, TARGETS, sql
from tidegrid.plans.registry import query
from tidegrid.session import cut, stage

XS = ["now", "mean_24", "delta_6", "day_before", "horizon_minutes"]


def cells(spark, d):
    """All supervised cells with origin features: the long training table."""
    return stage(spark, d, "supervised", lambda: build_cells(spark, d))


def build_cells(spark, d):
    feats = [*features.window_delta("target_all", 6), features.rolling("target_all", 24, "mean", 12),
             features.rolling("view", 24, "mean", 12), features.rolling("click", 24, "mean", 12)]
    o = features.build_features(base.origins_source(spark, d), KEYS, "ts", HOUR, feats).filter(on_grid("ts", STEP))
    o = o.select(*KEYS, F.col("ts").alias("origin"), F.col("target_all__now").alias("now"), F.col("target_part__now").alias("part_now"),
                 F.col("target_all__mean_24").alias("mean_24"), F.col("target_all__delta_6").alias("delta_6"),
                 F.col("view__mean_24").alias("view_24"), F.col("click__mean_24").alias("click_24"))
    y = base.labels_with_day_before(spark, d)
    x = expand_horizons(o, HORIZONS).withColumn("interval_start", interval_start("origin", "horizon_minutes", STEP))
    x = x.join(y, [*KEYS, "interval_start"], "left")
    return x.withColumns({"actual": F.col("target_all"), "part_actual": F.col("target_part"),
                          "day_before": F.col("target_all__day_before"),
                          "label_end": plus_minutes("interval_start", STEP - HOUR)})


def ols_sql(source: str, keys: str, xs: list[str], y: str) -> str:
    """Least squares per group as SQL text: moments, then Cramer's rule for one to three inputs."""
    p, idx = len(xs), range(len(xs))
    name = lambda i, j: f"c{min(i, j)}{max(i, j)}"
    sums = [f"covar_pop({xs[i]}, {xs[j]}) AS {name(i, j)}" for i in idx for j in idx if i <= j]
    sums += [f"covar_pop({x}, {y}) AS q{i}" for i, x in enumerate(xs)] + [f"avg({x}) AS e{i}" for i, x in enumerate(xs)]

    def det(m: list[list[str]]) -> str:
        if len(m) == 1:
            return m[0][0]
        minor = lambda c: [[v for k, v in enumerate(row) if k != c] for row in m[1:]]
        return "(" + " ".join(f"{'+' if c % 2 == 0 else '-'} {m[0][c]} * {det(minor(c))}" for c in range(len(m))) + ")"

    full = [[name(i, j) for j in idx] for i in idx]
    beta = lambda k: f"{det([[f'q{i}' if j == k else full[i][j] for j in idx] for i in idx])} / {det(full)} AS b_{xs[k]}"
    known = " AND ".join(f"{c} IS NOT NULL" for c in [*xs, y])
    group = f" GROUP BY {keys}" if keys else ""
    moments = f"SELECT {keys}, avg({y}) AS ey, {', '.join(sums)} FROM {source} WHERE {known}{group}"
    level = " - ".join(["ey", *[f"b_{x} * e{i}" for i, x in enumerate(xs)]])
    return f"SELECT *, {level} AS a FROM (SELECT *, {', '.join(beta(k) for k in idx)} FROM ({moments}))"


def training(x, folds=DEVELOPMENT):
    """Cells whose label was complete at the fold's train end, one copy per fold (folds are keys)."""
    return splits.explode_training(x.filter("actual IS NOT NULL"), folds, F.col("label_end"))


def validation(x, folds=DEVELOPMENT):
    return x.withColumn("fold_id", splits.validation_fold("origin", folds)).filter("fold_id IS NOT NULL")


TRAIN_SQL = {
    "tr": f"""SELECT f.fold_id, o.series_id, o.origin, h.horizon_minutes, o.target_all__now AS now, y.target_all AS actual, d.target_all AS day_before FROM origins o CROSS JOIN horizons h
    JOIN labels y ON y.series_id = o.series_id AND y.ts = o.origin + to_minutes(CAST(h.horizon_minutes - {STEP} AS BIGINT)) AND y.target_all IS NOT NULL
    LEFT JOIN labels d ON d.series_id = o.series_id AND d.ts = y.ts - INTERVAL '1 day'
    JOIN folds f ON f.role = 'development' AND y.ts + INTERVAL '180 minutes' <= f.train_end""",
    "va": "SELECT fold_id, series_id, origin, horizon_minutes, target_all__now AS now, target_all AS actual, all_before AS day_before FROM wide_cells WHERE target_all IS NOT NULL",
}
ONE_SQL = {**TRAIN_SQL, "ols": "SELECT fold_id, horizon_minutes, regr_slope(actual, now) AS b, regr_intercept(actual, now) AS a, regr_count(actual, now) AS n, stddev_pop(CASE WHEN actual IS NOT NULL THEN now END) AS sx FROM tr WHERE now IS NOT NULL GROUP BY 1, 2"}
NEEDS = ("wide_cells", "folds")


_W = "PARTITION BY series_id ORDER BY ts ROWS BETWEEN"
SUP_SQL = {
    "sf": f"""SELECT series_id, ts AS origin, target_all__now AS now, target_part__now AS part_now,
    CASE WHEN count(target_all) OVER ({_W} 23 PRECEDING AND CURRENT ROW) >= 12 THEN avg(target_all) OVER ({_W} 23 PRECEDING AND CURRENT ROW) END AS mean_24,
    CASE WHEN count(view) OVER ({_W} 23 PRECEDING AND CURRENT ROW) >= 12 THEN avg(view) OVER ({_W} 23 PRECEDING AND CURRENT ROW) END AS view_24,
    CASE WHEN count(click) OVER ({_W} 23 PRECEDING AND CURRENT ROW) >= 12 THEN avg(click) OVER ({_W} 23 PRECEDING AND CURRENT ROW) END AS click_24,
    CASE WHEN count(target_all) OVER ({_W} 5 PRECEDING AND CURRENT ROW) = 6 AND count(target_all) OVER ({_W} 11 PRECEDING AND 6 PRECEDING) = 6
      THEN avg(target_all) OVER ({_W} 5 PRECEDING AND CURRENT ROW) - avg(target_all) OVER ({_W} 11 PRECEDING AND 6 PRECEDING) END AS delta_6
    FROM filled QUALIFY ts = time_bucket(INTERVAL '240 minutes', ts, TIMESTAMP '1970-01-01')""",
    "sup": f"""SELECT s.*, h.horizon_minutes, y.target_all AS actual, y.target_part AS part_actual, d.target_all AS day_before, s.origin + to_minutes(CAST(h.horizon_minutes - {HOUR} AS BIGINT)) AS label_end,
    s.origin + to_minutes(CAST(h.horizon_minutes AS BIGINT)) AS target_ts FROM sf s CROSS JOIN horizons h
    LEFT JOIN labels y ON y.series_id = s.series_id AND y.ts = s.origin + to_minutes(CAST(h.horizon_minutes - {STEP} AS BIGINT))
    LEFT JOIN labels d ON d.series_id = s.series_id AND d.ts = s.origin + to_minutes(CAST(h.horizon_minutes - {STEP + 1440} AS BIGINT))""",
    "str": "SELECT f.fold_id, s.* FROM sup s JOIN folds f ON f.role = 'development' AND s.label_end <= f.train_end WHERE s.actual IS NOT NULL",
    "sva": "SELECT f.fold_id, s.* FROM sup s JOIN folds f ON f.role = 'development' AND s.origin BETWEEN f.validation_start AND f.validation_end",
}
SUP_NEEDS = ("filled", "labels", "horizons", "folds")
FH = "fold_id, horizon_minutes"


def linear_sql(xs: list[str], rows: str = "v", model: str = "m") -> str:
    return "greatest(0.0, " + " + ".join([f"{model}.a", *[f"{model}.b_{x} * {rows}.{x}" for x in xs]]) + ")"


def join_fh(rows: str, model: str) -> str:
    return f"{rows} v JOIN {model} m ON m.fold_id = v.fold_id AND m.horizon_minutes = v.horizon_minutes"


@query("m3_ols_per_horizon", "fold_id:s, series_id:s, origin:t, horizon_minutes:i, actual:d, prediction:d",
       sql("SELECT v.*, greatest(0.0, o.a + o.b * v.now) AS prediction FROM va v JOIN ols o ON o.fold_id = v.fold_id AND o.horizon_minutes = v.horizon_minutes WHERE v.now IS NOT NULL", *NEEDS, **ONE_SQL))
def ols(spark, d):
    """Every (fold, horizon) fit in one aggregate over the long table."""
    x = cells(spark, d)
    keys = ["fold_id", "horizon_minutes"]
    model = cut(fits.fit_linear(training(x).filter("now IS NOT NULL"), keys, ["now"], "actual"))
    return fits.predict_linear(validation(x).filter("now IS NOT NULL AND actual IS NOT NULL"), model, keys, ["now"], "prediction")


MED_SQL = {**TRAIN_SQL,
           "md": "SELECT fold_id, horizon_minutes, quantile_cont(now, 0.5) AS m1, quantile_cont(day_before, 0.5) AS m2 FROM tr GROUP BY 1, 2",
           "ft": "SELECT t.fold_id, t.horizon_minutes, actual AS y, coalesce(now, m1) AS x1, coalesce(day_before, m2) AS x2 FROM tr t JOIN md m ON m.fold_id = t.fold_id AND m.horizon_minutes = t.horizon_minutes",
           "mo": "SELECT fold_id, horizon_minutes, count(*) AS n, avg(x1) AS e1, avg(x2) AS e2, avg(y) AS ey, covar_pop(x1, x1) AS c11, covar_pop(x2, x2) AS c22, covar_pop(x1, x2) AS c12, covar_pop(x1, y) AS c1y, covar_pop(x2, y) AS c2y FROM ft GROUP BY 1, 2",
           "co": "SELECT *, (c1y * c22 - c2y * c12) / (c11 * c22 - c12 * c12) AS b1, (c2y * c11 - c1y * c12) / (c11 * c22 - c12 * c12) AS b2 FROM mo"}


def two_predictor_model(spark, d):
    x = cells(spark, d)
    keys, xs = ["fold_id", "horizon_minutes"], ["now", "day_before"]
    train = cut(training(x).select(*keys, *xs, "actual"))
    filled = fits.fill_medians(train.select(*keys, *xs), train, keys, xs)
    return cut(fits.fit_linear(filled, keys, xs, "actual"))


@query("m3_median_filled_ols", "fold_id:s, horizon_minutes:i, fit_rows:i, intercept:d, beta_now:d, beta_day_before:d",
       sql("SELECT fold_id, horizon_minutes, n AS fit_rows, ey - b1 * e1 - b2 * e2 AS intercept, b1 AS beta_now, b2 AS beta_day_before FROM co", *NEEDS, **MED_SQL))
def median_filled(spark, d):
    return two_predictor_model(spark, d)


@query("m13_coefficient_table", "fold_id:s, horizon_minutes:i, feature:s, coefficient:d, scaled_coefficient:d",
       sql("""SELECT fold_id, horizon_minutes, 'now' AS feature, b1 AS coefficient, b1 * sqrt(c11) AS scaled_coefficient FROM co UNION ALL SELECT fold_id, horizon_minutes, 'day_before', b2, b2 * sqrt(c22) FROM co""", *NEEDS, **MED_SQL))
def coefficient_table(spark, d):
    m = two_predictor_model(spark, d)
    items = F.array(*[F.struct(F.lit(x).alias("feature"), F.col(f"beta_{x}").alias("coefficient"), F.col(f"scaled_{x}").alias("scaled_coefficient"))
                      for x in ("now", "day_before")])
    return m.select("fold_id", "horizon_minutes", F.inline(items))


@query("m4_linear_proxy", "fold_id:s, series_id:s, ts:t, proxy:d",
       sql("""SELECT m.fold_id, p.series_id, p.ts, greatest(0.0, m.ey - m.b1 * m.e1 - m.b2 * m.e2 + m.b1 * p.view + m.b2 * p.click) AS proxy FROM panel p JOIN k m ON m.series_id = p.series_id WHERE p.view IS NOT NULL AND p.click IS NOT NULL""", "panel", "folds",
           f="SELECT f.fold_id, series_id, view AS x1, click AS x2, target_all AS y FROM panel JOIN folds f ON f.role = 'development' AND ts <= f.train_end WHERE view IS NOT NULL AND click IS NOT NULL AND target_all IS NOT NULL",
           mo="SELECT fold_id, series_id, avg(x1) AS e1, avg(x2) AS e2, avg(y) AS ey, covar_pop(x1, x1) AS c11, covar_pop(x2, x2) AS c22, covar_pop(x1, x2) AS c12, covar_pop(x1, y) AS c1y, covar_pop(x2, y) AS c2y FROM f GROUP BY 1, 2",
           k="SELECT *, (c1y * c22 - c2y * c12) / (c11 * c22 - c12 * c12) AS b1, (c2y * c11 - c1y * c12) / (c11 * c22 - c12 * c12) AS b2 FROM mo"))
def proxy(spark, d):
    """Two-signal linear proxy of the total, fitted on every fold's own history, floored at zero."""
    p = base.panel(spark, d).select(*KEYS, "ts", "view", "click", "target_all")
    keys = ["fold_id", *KEYS]
    model = cut(fits.fit_linear(splits.explode_training(p, DEVELOPMENT, F.col("ts")), keys, ["view", "click"], "target_all"))
    rows = lookup_join(p.filter("view IS NOT NULL AND click IS NOT NULL"), model.select(*keys), KEYS)
    return fits.predict_linear(rows, model, keys, ["view", "click"], "proxy")


@query("m5_weighted_l1_proxy", "fit_rows:i, intercept:d, beta_view:d, beta_click:d, weighted_error:d, least_squares_error:d, not_worse:b")
def l1_proxy(spark, d):
    """Relative-error line; it must score no worse than the weighted least-squares line."""
    p = base.panel(spark, d).filter("view IS NOT NULL AND click IS NOT NULL AND target_all > 0").withColumn(
        "w", blend.inverse_target_weight(F.col("target_all"), 1.0)).select("view", "click", "target_all", "w")
    p = cut(p)
    l1 = fits.fit_weighted_l1(p, ["view", "click"], "target_all", "w", rounds=12)
    l2 = fits.fit_linear(p.withColumn("_fit", F.lit(0)), ["_fit"], ["view", "click"], "target_all", "w").drop("_fit")
    err = lambda m: fits.predict_linear(p, m, [], ["view", "click"], "q", floor=None).agg(
        F.sum(F.col("w") * F.abs(F.col("target_all") - F.col("q")))).first()[0]
    l1 = cut(l1)
    ours, squares = err(l1), err(l2)
    return l1.withColumns({"weighted_error": F.lit(ours), "least_squares_error": F.lit(squares),
                           "not_worse": F.lit(ours <= squares * 1.0001)})


@query("m1_direct_trees", f"fold_id:s, horizon_minutes:i, {STRICT_SPEC}")
def direct_trees(spark, d):
    """One tree ensemble per (fold, horizon); fits overlap from a small thread pool.

    The training table is laid out by group, so each fit reads only its own files.
    """
    x = cells(spark, d)
    train, valid = cut(training(x), ["fold_id", "horizon_minutes"]), validation(x).filter("actual IS NOT NULL")
    xs = [c for c in XS if c != "horizon_minutes"]
    groups = [(f.fold_id, h) for f in DEVELOPMENT for h in HORIZONS]

    def job(group):
        pick = (F.col("fold_id") == group[0]) & (F.col("horizon_minutes") == group[1])
        model = trees.tree_model(train.filter(pick), xs, "actual", rounds=5)
        return trees.score(model, valid.filter(pick), ["fold_id", "horizon_minutes", "actual"])

    scored = union_forecasts(trees.per_group(groups, job))
    return scored.groupBy("fold_id", "horizon_minutes").agg(*metrics.strict_errors())


@query("m1_direct_linear", f"fold_id:s, horizon_minutes:i, {STRICT_SPEC}",
       sql(f"SELECT fold_id, horizon_minutes, {STRICT} FROM (SELECT v.fold_id, v.horizon_minutes, v.actual, greatest(0.0, o.a + o.b * v.now) AS prediction FROM va v JOIN ols o ON o.fold_id = v.fold_id AND o.horizon_minutes = v.horizon_minutes WHERE v.now IS NOT NULL) GROUP BY 1, 2", *NEEDS, **ONE_SQL))
def direct_linear(spark, d):
    return ols(spark, d).groupBy("fold_id", "horizon_minutes").agg(*metrics.strict_errors())


@query("m2_shared_horizon_trees", f"fold_id:s, period:s, {STRICT_SPEC}")
def shared_trees(spark, d):
    """One ensemble over the horizons of each fold and period, weighted by the inverse target."""
    period = F.when(F.col("horizon_minutes") <= base.SHORT_LIMIT, "short").otherwise("long")
    x = cells(spark, d).withColumn("period", period)
    train = cut(training(x).withColumn("w", blend.inverse_target_weight(F.col("actual"), 25.0)), ["fold_id", "period"])
    valid = validation(x).filter("actual IS NOT NULL")

    def job(group):
        pick = (F.col("fold_id") == group[0]) & (F.col("period") == group[1])
        model = trees.tree_model(train.filter(pick), XS, "actual", "w", rounds=8)
        return trees.score(model, valid.filter(pick), ["fold_id", "period", "actual"])

    groups = [(f.fold_id, p) for f in DEVELOPMENT for p in ("short", "long")]
    return union_forecasts(trees.per_group(groups, job)).groupBy("fold_id", "period").agg(*metrics.strict_errors())


@query("m13_feature_importance", "fold_id:s, feature:s, importance:d")
def importance(spark, d):
    """Of each fold's own ensemble."""
    train = cut(training(cells(spark, d)), ["fold_id"])

    def job(fold):
        model = trees.tree_model(train.filter(F.col("fold_id") == fold), XS, "actual", rounds=5)
        return trees.importances(model, XS, spark).select(F.lit(fold).alias("fold_id"), "feature", "importance")

    return union_forecasts(trees.per_group([f.fold_id for f in DEVELOPMENT], job))


@query("m8_two_stage", f"fold_id:s, {STRICT_SPEC}",
       sql(f"SELECT fold_id, {STRICT} FROM scored GROUP BY 1", *SUP_NEEDS, **SUP_SQL,
           t1="SELECT * FROM str WHERE now IS NOT NULL AND part_now IS NOT NULL", one=ols_sql("t1", FH, ["part_now", "now"], "part_actual"),
           t2=f"SELECT v.*, {linear_sql(['part_now', 'now'])} AS part_path FROM {join_fh('t1', 'one')}", two=ols_sql("t2", FH, ["now", "part_path"], "actual"),
           v2=f"SELECT v.*, {linear_sql(['part_now', 'now'])} AS part_path FROM {join_fh('sva', 'one')} WHERE now IS NOT NULL AND part_now IS NOT NULL AND actual IS NOT NULL",
           scored=f"SELECT v.fold_id, v.actual, {linear_sql(['now', 'part_path'])} AS prediction FROM {join_fh('v2', 'two')}"))
def two_stage(spark, d):
    """Stage one forecasts the part's path, stage two the total from origin state and that path."""
    x = cells(spark, d).filter("now IS NOT NULL AND part_now IS NOT NULL")
    keys = ["fold_id", "horizon_minutes"]
    train, valid = cut(training(x)), cut(validation(x).filter("actual IS NOT NULL"))
    one = cut(fits.fit_linear(train, keys, ["part_now", "now"], "part_actual"))
    path = lambda rows: fits.predict_linear(rows, one, keys, ["part_now", "now"], "part_path").filter("part_path IS NOT NULL")
    two = cut(fits.fit_linear(path(train), keys, ["now", "part_path"], "actual"))
    scored = fits.predict_linear(path(valid), two, keys, ["now", "part_path"], "prediction")
    return scored.groupBy("fold_id").agg(*metrics.strict_errors())


def _rollout_sql() -> dict[str, str]:
    """The six steps written out: each one reads the values before it."""
    lags = "lag(target_all, 1) OVER w AS lag_1, lag(target_all, 2) OVER w AS lag_2"
    past = ", ".join(f"lag(target_all, {7 - i}) OVER w AS h{i}" for i in range(1, 7))
    out = {
        "lg": f"""SELECT series_id, ts, target_all, {lags}, {past}, CASE WHEN count(target_all) OVER m = 6 THEN avg(target_all) OVER m END AS mean FROM labels
    WINDOW w AS (PARTITION BY series_id ORDER BY ts), m AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)""",
        "lt": "SELECT f.fold_id, l.* FROM lg l JOIN folds f ON f.role = 'development' AND l.ts + INTERVAL '180 minutes' <= f.train_end",
        "lm": ols_sql("lt", "fold_id", ["lag_1", "lag_2", "mean"], "target_all"),
        "s0": f"""SELECT f.fold_id, l.series_id, l.ts AS origin, {', '.join(f'h{i}' for i in range(1, 7))}, m.a, m.b_lag_1, m.b_lag_2, m.b_mean FROM lg l
    JOIN folds f ON f.role = 'development' AND l.ts BETWEEN f.validation_start AND f.validation_end JOIN lm m ON m.fold_id = f.fold_id WHERE mean IS NOT NULL""",
    }
    for k in range(1, 7):
        seen = [f"h{i}" for i in range(k, k + 6)]
        out[f"s{k}"] = f"SELECT *, greatest(0.0, a + b_lag_1 * {seen[-1]} + b_lag_2 * {seen[-2]} + b_mean * ({' + '.join(seen)}) / 6.0) AS h{k + 6} FROM s{k - 1}"
    out["ro"] = " UNION ALL ".join(f"SELECT fold_id, series_id, origin, {240 * k} AS horizon_minutes, h{k + 6} AS prediction FROM s6" for k in range(1, 7))
    return out


@query("m9_recursive_rollout", f"fold_id:s, horizon_minutes:i, {STRICT_SPEC}",
       sql(f"""SELECT fold_id, horizon_minutes, {STRICT} FROM (SELECT r.*, y.target_all AS actual FROM ro r JOIN origins o ON o.series_id = r.series_id AND o.origin = r.origin
  LEFT JOIN labels y ON y.series_id = r.series_id AND y.ts = r.origin + to_minutes(CAST(r.horizon_minutes - 240 AS BIGINT))) GROUP BY 1, 2""", "labels", "folds", "origins", **_rollout_sql()))
def rollout(spark, d):
    """Autoregression on the interval grid, its own forecasts fed back as lags."""
    y = base.labels(spark, d)
    feats = [features.lag("target_all", 1), features.lag("target_all", 2), features.rolling("target_all", 6, "mean", 6, newest=-1, label="mean_6")]
    rows = features.build_features(y, KEYS, "ts", STEP, feats).select(
        *KEYS, "ts", "target_all", F.col("target_all__lag_1").alias("lag_1"), F.col("target_all__lag_2").alias("lag_2"), F.col("mean_6").alias("mean"))
    train = splits.explode_training(rows, DEVELOPMENT, plus_minutes("ts", STEP - HOUR))
    model = cut(fits.fit_linear(train, ["fold_id"], ["lag_1", "lag_2", "mean"], "target_all"))
    # The window ends with the interval just before the origin: [origin - step, origin).
    past = features.sequence_window(y, KEYS, "ts", ["target_all"], 6, STEP, "past").select(
        *KEYS, plus_minutes("ts", STEP).alias("origin"), F.transform("past", lambda s: s["target_all"]).alias("history"))
    past = past.withColumn("fold_id", splits.validation_fold("origin", DEVELOPMENT)).filter("fold_id IS NOT NULL")
    ready = lookup_join(past, model.select("fold_id", "intercept", "beta_lag_1", "beta_lag_2", "beta_mean"), ["fold_id"])
    path = reconcile.recursive_rollout(ready, "history", len(HORIZONS), (1, 2), 6)
    steps = F.arrays_zip(F.array(*[F.lit(h) for h in HORIZONS]).alias("horizon_minutes"), F.col("path").alias("prediction"))
    long = path.select("fold_id", *KEYS, "origin", F.inline(steps)).toDF("fold_id", *KEYS, "origin", "horizon_minutes", "prediction")
    actual = cells(spark, d).select(*KEYS, "origin", "horizon_minutes", "actual")
    return long.join(actual, [*KEYS, "origin", "horizon_minutes"]).groupBy("fold_id", "horizon_minutes").agg(*metrics.strict_errors())


@query("m10_hierarchical", f"model:s, fold_id:s, {STRICT_SPEC}",
       sql(f"SELECT model, fold_id, {STRICT} FROM scored GROUP BY 1, 2", *SUP_NEEDS, **SUP_SQL,
           ht="SELECT *, now - part_now AS other_now, actual - part_actual AS other_actual FROM str WHERE now IS NOT NULL AND part_now IS NOT NULL AND part_actual IS NOT NULL",
           hv="SELECT *, now - part_now AS other_now FROM sva WHERE now IS NOT NULL AND part_now IS NOT NULL AND part_actual IS NOT NULL",
           fa=ols_sql("ht", FH, ["now"], "actual"), fo=ols_sql("ht", FH, ["other_now"], "other_actual"), fp=ols_sql("ht", FH, ["part_now"], "part_actual"),
           paths=f"SELECT v.fold_id, v.part_actual, v.total, v.other, {linear_sql(['part_now'])} AS direct FROM (SELECT v.*, {linear_sql(['other_now'])} AS other FROM (SELECT v.*, {linear_sql(['now'])} AS total FROM {join_fh('hv', 'fa')}) v JOIN fo m USING (fold_id, horizon_minutes)) v JOIN fp m USING (fold_id, horizon_minutes)",
           scored="SELECT 'derived' AS model, fold_id, part_actual AS actual, greatest(0.0, least(total - other, 400.0, total)) AS prediction FROM paths UNION ALL SELECT 'direct', fold_id, part_actual, direct FROM paths"))
def hierarchical(spark, d):
    """Part derived as a forecast of the total minus a forecast of the rest, beside a forecast of the part itself."""
    x = cells(spark, d).filter("now IS NOT NULL AND part_now IS NOT NULL AND part_actual IS NOT NULL")
    x = x.withColumns({"other_now": F.col("now") - F.col("part_now"), "other_actual": F.col("actual") - F.col("part_actual")})
    keys = ["fold_id", "horizon_minutes"]
    train, rows = cut(training(x)), validation(x)
    for seen, wanted, out in (("now", "actual", "total"), ("other_now", "other_actual", "other"), ("part_now", "part_actual", "direct")):
        rows = fits.predict_linear(rows, fits.fit_linear(train, keys, [seen], wanted), keys, [seen], out)
    derived = blend.residual_part(F.col("total"), F.col("other"), 400.0)
    models = F.array(F.struct(F.lit("derived").alias("model"), derived.alias("prediction")), F.struct(F.lit("direct").alias("model"), F.col("direct").alias("prediction")))
    scored = rows.select("fold_id", F.col("part_actual").alias("actual"), F.inline(models))
    return scored.groupBy("model", "fold_id").agg(*metrics.strict_errors())


VARIANTS = {"control": ["now"], "with_level": ["now", "mean_24"], "with_trend": ["now", "delta_6"], "with_season": ["now", "day_before"]}


def _variant_sql(sets: dict[str, list[str]], label: str, complete: list[str]) -> dict[str, str]:
    """The same complete cells fitted and scored once per named column set."""
    whole = " AND ".join(f"{c} IS NOT NULL" for c in complete)
    out = {"ct": f"SELECT * FROM str WHERE {whole}", "cv": f"SELECT * FROM sva WHERE {whole} AND actual IS NOT NULL"}
    parts = []
    for n, xs in sets.items():
        out[f"fit_{n}"] = ols_sql("ct", FH, xs, "actual")
        parts.append(f"SELECT '{n}' AS {label}, v.fold_id, v.actual, {linear_sql(xs)} AS prediction FROM {join_fh('cv', 'fit_' + n)}")
    return {**out, "scored": " UNION ALL ".join(parts)}


@query("m11_feature_group_ablation", f"variant:s, fold_id:s, {STRICT_SPEC}",
       sql(f"SELECT variant, fold_id, {STRICT} FROM scored GROUP BY 1, 2", *SUP_NEEDS, **SUP_SQL, **_variant_sql(VARIANTS, "variant", ["now", "mean_24", "delta_6", "day_before"])))
def ablation(spark, d):
    """The same folds and complete cells for every feature group."""
    x = cut(cells(spark, d).dropna(subset=["now", "mean_24", "delta_6", "day_before"]))
    keys = ["fold_id", "horizon_minutes"]
    train, valid = cut(training(x)), validation(x).filter("actual IS NOT NULL")
    parts = [fits.predict_linear(valid, fits.fit_linear(train, keys, xs, "actual"), keys, xs, "prediction")
             .select(F.lit(v).alias("variant"), "fold_id", "actual", "prediction") for v, xs in VARIANTS.items()]
    return union_forecasts(parts).groupBy("variant", "fold_id").agg(*metrics.strict_errors())


PROXY_SHARE = 0.3


@query("m12_label_definition_grid", f"model_label:s, proxy_label:s, {STRICT_SPEC}",
       sql(f"SELECT model_label, proxy_label, {STRICT} FROM u GROUP BY 1, 2", *SUP_NEEDS, "panel", **SUP_SQL,
           pt="SELECT s.*, p.target_all AS point FROM sup s LEFT JOIN panel p ON p.series_id = s.series_id AND p.ts = s.target_ts WHERE s.now IS NOT NULL",
           ti="SELECT f.fold_id, p.* FROM pt p JOIN folds f ON f.role = 'development' AND p.label_end <= f.train_end",
           tp="SELECT f.fold_id, p.* FROM pt p JOIN folds f ON f.role = 'development' AND p.target_ts <= f.train_end",
           xp="SELECT f.fold_id, p.series_id, p.view, p.click, p.target_all AS y FROM panel p JOIN folds f ON f.role = 'development' AND p.ts <= f.train_end",
           xi="SELECT f.fold_id, p.series_id, p.view, p.click, l.target_all AS y FROM panel p JOIN labels l ON l.series_id = p.series_id AND l.ts = p.ts JOIN folds f ON f.role = 'development' AND p.ts + INTERVAL '180 minutes' <= f.train_end",
           mi=ols_sql("ti", FH, ["now"], "actual"), mp=ols_sql("tp", FH, ["now"], "point"),
           ki=ols_sql("xi", "fold_id, series_id", ["view", "click"], "y"), kp=ols_sql("xp", "fold_id, series_id", ["view", "click"], "y"),
           vp="SELECT f.fold_id, s.*, p.view, p.click FROM pt s JOIN folds f ON f.role = 'development' AND s.origin BETWEEN f.validation_start AND f.validation_end LEFT JOIN panel p ON p.series_id = s.series_id AND p.ts = s.origin",
           trees=f"SELECT v.*, 'interval' AS model_label, {linear_sql(['now'])} AS tree FROM {join_fh('vp', 'mi')} UNION ALL SELECT v.*, 'point', {linear_sql(['now'])} FROM {join_fh('vp', 'mp')}",
           u=f"""SELECT v.model_label, 'interval' AS proxy_label, v.actual, {1 - PROXY_SHARE} * v.tree + {PROXY_SHARE} * {linear_sql(['view', 'click'])} AS prediction FROM trees v JOIN ki m ON m.fold_id = v.fold_id AND m.series_id = v.series_id WHERE v.view IS NOT NULL AND v.click IS NOT NULL
  UNION ALL SELECT v.model_label, 'point', v.actual, {1 - PROXY_SHARE} * v.tree + {PROXY_SHARE} * {linear_sql(['view', 'click'])} FROM trees v JOIN kp m ON m.fold_id = v.fold_id AND m.series_id = v.series_id WHERE v.view IS NOT NULL AND v.click IS NOT NULL"""))
def label_grid(spark, d):
    """Model and two-signal proxy each fitted on interval or point labels, blended, scored on the interval label."""
    x = cells(spark, d).filter("now IS NOT NULL").withColumn("target_ts", plus_minutes("origin", F.col("horizon_minutes")))
    panel = cut(base.panel(spark, d).select(*KEYS, "ts", "view", "click", "target_all"))
    point = panel.select(*KEYS, F.col("ts").alias("target_ts"), F.col("target_all").alias("point"))
    x = cut(join_keys(x, point, [*KEYS, "target_ts"], "left"))
    keys, site, signals, kinds = ["fold_id", "horizon_minutes"], ["fold_id", *KEYS], ["view", "click"], ("interval", "point")
    # A point label is known at its own moment, an interval label one sample before the horizon ends.
    rows = validation(x)
    for kind, label, at in zip(kinds, ("actual", "point"), ("label_end", "target_ts")):
        rows = fits.predict_linear(rows, fits.fit_linear(splits.explode_training(x, DEVELOPMENT, F.col(at)), keys, ["now"], label), keys, ["now"], f"model_{kind}")
    rows = join_keys(rows, panel.select(*KEYS, F.col("ts").alias("origin"), *signals), [*KEYS, "origin"]).filter("view IS NOT NULL AND click IS NOT NULL")
    interval = join_keys(panel.drop("target_all"), base.labels(spark, d).select(*KEYS, "ts", "target_all"), [*KEYS, "ts"])
    for kind, history, at in zip(kinds, (interval, panel), (plus_minutes("ts", STEP - HOUR), F.col("ts"))):
        rows = fits.predict_linear(rows, fits.fit_linear(splits.explode_training(history, DEVELOPMENT, at), site, signals, "target_all"), site, signals, f"proxy_{kind}")
    items = F.array(*[F.struct(F.lit(a).alias("model_label"), F.lit(b).alias("proxy_label"), (F.col(f"model_{a}") * (1 - PROXY_SHARE) + F.col(f"proxy_{b}") * PROXY_SHARE).alias("prediction")) for a in kinds for b in kinds])
    return rows.select("actual", F.inline(items)).groupBy("model_label", "proxy_label").agg(*metrics.strict_errors())


COLUMN_SETS = {"reduced": ["now"], "restored": ["now", "view_24", "click_24"]}


@query("m14_column_set_comparison", f"column_set:s, {STRICT_SPEC}",
       sql(f"SELECT column_set, {STRICT} FROM scored GROUP BY 1", *SUP_NEEDS, **SUP_SQL, **_variant_sql(COLUMN_SETS, "column_set", ["now", "view_24", "click_24"])))
def column_sets(spark, d):
    """The same fits with and without the signals that had been left out."""
    x = cut(cells(spark, d).dropna(subset=["now", "view_24", "click_24"]))
    keys = ["fold_id", "horizon_minutes"]
    train, valid = cut(training(x)), validation(x).filter("actual IS NOT NULL")
    parts = [fits.predict_linear(valid, fits.fit_linear(train, keys, xs, "actual"), keys, xs, "prediction").select(
        F.lit(n).alias("column_set"), "actual", "prediction") for n, xs in COLUMN_SETS.items()]
    return union_forecasts(parts).groupBy("column_set").agg(*metrics.strict_errors())
