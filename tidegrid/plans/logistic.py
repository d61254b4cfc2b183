"""Logistic queries: onset hazard per episode group and horizon, sequential expert gate, domain similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.functions import blend
from tidegrid.functions.timeline import plus_minutes
from tidegrid.operators import features, intervals, logistic, metrics, splits
from tidegrid.operators.sizing import join_keys, lookup_join
from tidegrid.plans import base, events_base as ev, joins
from tidegrid.plans.base import DEVELOPMENT, FRAGMENTS, HORIZONS, HOUR, KEYS, sql
from tidegrid.plans.registry import query
from tidegrid.session import cut, stage

XS = ["ratio", "delta_6", "view_24"]
GATE_XS = ["mean_disagreement", "mean_absolute_disagreement", "ratio"]
ORDER = [f.fold_id for f in DEVELOPMENT]
GROUPS, DAY_FOLDS, BUDGET = 3, 5, 0.1
DOMAIN_END = base.FOLDS[2].train_end
STEPS = 12   # Newton steps of the SQL twin: full steps from zero have converged by then


def determinant(m: list[list[str]]) -> str:
    if len(m) == 1:
        return m[0][0]
    minor = lambda c: [[v for k, v in enumerate(row) if k != c] for row in m[1:]]
    return "(" + " ".join(f"{'+' if c % 2 == 0 else '-'} {m[0][c]} * {determinant(minor(c))}" for c in range(len(m))) + ")"


def logistic_sql(name: str, source: str, keys: list[str], xs: list[str], y: str, ridge: float = logistic.RIDGE) -> dict[str, str]:
    """CTEs that fit every group of ``source`` by Newton steps with Cramer's rule; ``{name}_fit`` holds the coefficients."""
    p, by = len(xs) + 1, ", ".join(keys)
    on = lambda a, b: " AND ".join(f"{a}.{k} IS NOT DISTINCT FROM {b}.{k}" for k in keys)
    out = {
        f"{name}_m": f"SELECT {by}, {', '.join(f'coalesce(quantile_cont({x}, 0.5), 0.0) AS median_{x}' for x in xs)} FROM {source} GROUP BY {by}",
        f"{name}_f": f"SELECT {', '.join(f's.{k}' for k in keys)}, {', '.join(f'coalesce(s.{x}, m.median_{x}) AS {x}, m.median_{x}' for x in xs)}, CAST(s.{y} AS DOUBLE) AS y FROM {source} s JOIN {name}_m m ON {on('s', 'm')} WHERE s.{y} IS NOT NULL",
        f"{name}_s": f"SELECT {by}, count(*) AS fit_rows, CAST(sum(y) AS BIGINT) AS positives, " + ", ".join(
            f"max(median_{x}) AS median_{x}, avg({x}) AS mean_{x}, CASE WHEN stddev_pop({x}) > {logistic.FLAT} THEN stddev_pop({x}) ELSE 1.0 END AS deviation_{x}" for x in xs) + f" FROM {name}_f GROUP BY {by}",
        f"{name}_z": f"SELECT {', '.join(f'f.{k}' for k in keys)}, f.y, 1.0::DOUBLE AS z0, {', '.join(f'(f.{x} - s.mean_{x}) / s.deviation_{x} AS z{i + 1}' for i, x in enumerate(xs))} FROM {name}_f f JOIN {name}_s s ON {on('f', 's')} WHERE s.positives > 0 AND s.positives < s.fit_rows",
        f"{name}_b0": f"SELECT DISTINCT {by}, {', '.join(f'0.0::DOUBLE AS b{i}' for i in range(p))} FROM {name}_z",
    }
    score = " + ".join(f"b.b{i} * z.z{i}" for i in range(p))
    g = ", ".join(f"avg((p - y) * z{i}){f' + {ridge} * max(b{i})' if i else ''} AS g{i}" for i in range(p))
    h = ", ".join(f"avg(p * (1 - p) * z{i} * z{j}){f' + {ridge}' if i == j and i else ''} AS h{i}{j}" for i in range(p) for j in range(i, p))
    full = [[f"h{min(i, j)}{max(i, j)}" for j in range(p)] for i in range(p)]
    moved = [determinant([[f"g{i}" if j == k else full[i][j] for j in range(p)] for i in range(p)]) for k in range(p)]
    for s in range(STEPS):
        out[f"{name}_h{s}"] = f"SELECT {by}, {', '.join(f'max(b{i}) AS b{i}' for i in range(p))}, {g}, {h} FROM (SELECT z.*, {', '.join(f'b.b{i}' for i in range(p))}, 1.0 / (1.0 + exp(-({score}))) AS p FROM {name}_z z JOIN {name}_b{s} b ON {on('z', 'b')}) GROUP BY {by}"
        out[f"{name}_b{s + 1}"] = f"SELECT {by}, {', '.join(f'b{k} - {moved[k]} / d AS b{k}' for k in range(p))} FROM (SELECT *, {determinant(full)} AS d FROM {name}_h{s})"
    level = " - ".join(["b.b0", *[f"b.b{i + 1} / s.deviation_{x} * s.mean_{x}" for i, x in enumerate(xs)]])
    out[f"{name}_fit"] = f"SELECT s.*, {level} AS intercept, {', '.join(f'b.b{i + 1} AS scaled_{x}, b.b{i + 1} / s.deviation_{x} AS beta_{x}' for i, x in enumerate(xs))} FROM {name}_s s LEFT JOIN {name}_b{STEPS} b ON {on('s', 'b')}"
    return out


def chance_sql(xs: list[str], fit: str = "m", row: str = "x") -> str:
    return f"1.0 / (1.0 + exp(-({fit}.intercept + {' + '.join(f'{fit}.beta_{x} * coalesce({row}.{x}, {fit}.median_{x})' for x in xs)})))"


BINARY_SPEC = "rows:i, positive_rows:i, brier:d, roc_auc:d, average_precision:d, alert_rate:d, alert_precision:d, alert_recall:d"


def binary_sql(source: str, keys: str) -> str:
    """Scores of probability ``p``, label ``y`` and ``alert`` per group; AUC by average ranks, precision by distinct scores."""
    return f"""SELECT {keys}, count(*) AS rows, sum(y) AS positive_rows, avg((p - y) * (p - y)) AS brier, avg(CAST(alert AS DOUBLE)) AS alert_rate,
  CASE WHEN sum(alert) > 0 THEN sum(alert * y) / sum(alert) END AS alert_precision, CASE WHEN sum(y) > 0 THEN sum(alert * y) / sum(y) END AS alert_recall,
  (sum(y * (below + (same + 1) / 2.0)) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0) AS roc_auc,
  CASE WHEN sum(y) > 0 THEN sum(y * (total_y - below_y) * 1.0 / (total - below)) / sum(y) ELSE NULL END AS average_precision
FROM (SELECT *, count(*) OVER s AS same, count(*) OVER g AS total, sum(y) OVER g AS total_y,
    rank() OVER (PARTITION BY {keys} ORDER BY p) - 1 AS below, coalesce(sum(y) OVER (PARTITION BY {keys} ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) - sum(y) OVER s AS below_y
  FROM {source} WINDOW s AS (PARTITION BY {keys}, p), g AS (PARTITION BY {keys})) GROUP BY {keys}"""


# --- onset hazard --------------------------------------------------------------------------------

def state_rows(spark, d):
    """Origin state of every hour with a low-level ratio, and the next episode start within the longest horizon."""
    feats = [*features.low_level_ratio("target_all", ev.SHORT_ROWS, ev.BASE_ROWS, ev.BASE_MIN, "ratio"), *features.window_delta("target_all", 6), features.rolling("view", 24, "mean", 12)]
    x = features.build_features(base.panel(spark, d), KEYS, "ts", HOUR, feats).filter("ratio IS NOT NULL")
    x = x.select(*KEYS, F.col("ts").alias("origin"), "ratio", F.col("target_all__delta_6").alias("delta_6"), F.col("view__mean_24").alias("view_24"))
    return intervals.next_event(x, ev.episodes(spark, d), KEYS, "origin", "episode_start", max(HORIZONS))


FRAGMENTS["states"] = (("ratios", "panel", "episodes"), f"""SELECT x.*, (SELECT min(e.episode_start) FROM episodes e WHERE e.series_id = x.series_id AND e.episode_start > x.origin AND e.episode_start <= x.origin + INTERVAL '{max(HORIZONS)} minutes') AS next_start FROM (
    SELECT r.series_id, r.ts AS origin, r.ratio, w.m6 - w.b6 AS delta_6, w.view_24 FROM ratios r JOIN (
      SELECT series_id, ts, m6, lag(m6, 6) OVER (PARTITION BY series_id ORDER BY ts) AS b6, view_24 FROM (
        SELECT series_id, ts, CASE WHEN count(target_all) OVER a = 6 THEN avg(target_all) OVER a END AS m6, CASE WHEN count("view") OVER v >= 12 THEN avg("view") OVER v END AS view_24 FROM panel
        WINDOW a AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), v AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))) w
    ON w.series_id = r.series_id AND w.ts = r.ts WHERE r.ratio IS NOT NULL) x""")
FRAGMENTS["bounds"] = (("episodes", "horizons"), f"""SELECT *, validation_start - to_minutes(CAST(horizon_minutes AS BIGINT)) AS train_end FROM (
    SELECT episode_number % {GROUPS} AS episode_group, min(episode_start) - INTERVAL '{max(HORIZONS)} minutes' AS validation_start, max(episode_start) AS validation_end FROM episodes GROUP BY 1) CROSS JOIN horizons""")

GH = ["episode_group", "horizon_minutes"]
HAZARD_SQL = {
    "ht": f"SELECT b.episode_group, b.horizon_minutes, s.*, CASE WHEN s.next_start <= s.origin + to_minutes(CAST(b.horizon_minutes AS BIGINT)) THEN 1 ELSE 0 END AS y FROM states s JOIN bounds b ON s.origin <= b.train_end",
    "hv": f"SELECT b.episode_group, b.horizon_minutes, s.*, CASE WHEN s.next_start <= s.origin + to_minutes(CAST(b.horizon_minutes AS BIGINT)) THEN 1 ELSE 0 END AS y FROM states s JOIN bounds b ON s.origin >= b.validation_start AND s.origin < b.validation_end",
    **logistic_sql("hz", "ht", GH, XS, "y"),
    "cuts": f"SELECT x.episode_group, x.horizon_minutes, quantile_cont({chance_sql(XS)}, {1 - BUDGET}) AS threshold FROM ht x JOIN hz_fit m USING (episode_group, horizon_minutes) GROUP BY ALL",
    "hp": f"SELECT x.episode_group, x.horizon_minutes, {chance_sql(XS)} AS p, x.y, CASE WHEN {chance_sql(XS)} >= c.threshold THEN 1 ELSE 0 END AS alert FROM hv x JOIN hz_fit m USING (episode_group, horizon_minutes) JOIN cuts c USING (episode_group, horizon_minutes) WHERE m.intercept IS NOT NULL",
}


def hazard_rows(spark, d):
    """(training rows, validation rows) of every episode group and horizon: groups are keys, bounds are literals of a small table.

    An origin may train while its outcome, a horizon later, is known before the first held-out episode is near.
    """
    x = stage(spark, d, "states", lambda: state_rows(spark, d))
    e = ev.episodes(spark, d).withColumn("episode_group", (F.col("episode_number") % GROUPS).cast("int"))
    table = splits.embargo_folds(e, "episode_group", HORIZONS).collect()   # GROUPS x horizons rows
    at = lambda v: F.lit(v).cast("timestamp_ntz")
    mark = lambda b: F.struct(F.lit(b.episode_group).alias("episode_group"), F.lit(b.horizon_minutes).alias("horizon_minutes"))
    chosen = lambda test: F.explode(F.filter(F.array(*[F.when(test(b), mark(b)) for b in table]), lambda v: v.isNotNull())) if table else F.explode(F.array().cast("array<struct<episode_group:int,horizon_minutes:int>>"))
    y = (F.col("next_start").isNotNull() & (F.col("next_start") <= plus_minutes("origin", F.col("horizon_minutes")))).cast("int")
    rows = lambda test: x.select("*", chosen(test).alias("_g")).select("_g.*", *KEYS, "origin", *XS, "next_start").withColumn("y", y)
    return rows(lambda b: F.col("origin") <= at(b.train_end)), rows(lambda b: (F.col("origin") >= at(b.validation_start)) & (F.col("origin") < at(b.validation_end)))


def hazard_fits(spark, d):
    train, valid = hazard_rows(spark, d)
    return train, valid, logistic.fit_logistic(train, GH, XS, "y")


@query("m6_hazard_coefficients", "episode_group:i, horizon_minutes:i, fit_rows:i, positives:i, intercept:d, " + ", ".join(f"scaled_{x}:d" for x in XS) + ", gradient:d",
       sql(f"SELECT episode_group, horizon_minutes, fit_rows, positives, intercept, {', '.join(f'scaled_{x}' for x in XS)}, CASE WHEN intercept IS NOT NULL THEN 0.0 END AS gradient FROM hz_fit", "states", "bounds", **HAZARD_SQL))
def hazard_coefficients(spark, d):
    """Coefficients on the standardised scale of every fit, and its largest gradient component: zero."""
    return hazard_fits(spark, d)[2]


@query("m6_logistic_hazard", f"episode_group:i, horizon_minutes:i, {BINARY_SPEC}", sql(binary_sql("hp", "episode_group, horizon_minutes"), "states", "bounds", **HAZARD_SQL))
def hazard_scores(spark, d):
    """Held-out scores per episode group and horizon; alerts above a quantile of the training probabilities."""
    train, valid, model = hazard_fits(spark, d)
    cuts = metrics.alert_thresholds(logistic.logistic_probability(train, model, GH, XS).filter("probability IS NOT NULL"), GH, "probability", BUDGET)
    p = lookup_join(logistic.logistic_probability(valid, model, GH, XS).filter("probability IS NOT NULL"), cuts, GH)
    return metrics.binary_scores(cut(p.withColumn("alert", (F.col("probability") >= F.col("alert_threshold")).cast("int"))), GH, "probability", "y", "alert")


# --- expert gate ---------------------------------------------------------------------------------

FRAGMENTS["shapes"] = (("forecasts", "ratios"), f"""SELECT t.*, r.ratio FROM (SELECT fold_id, series_id, origin, avg(d) AS mean_disagreement, avg(abs(d)) AS mean_absolute_disagreement, CASE WHEN avg(ca) < avg(co) THEN 1 ELSE 0 END AS y FROM (
    SELECT fold_id, series_id, origin, candidate - control AS d, abs((candidate - actual) / actual) AS ca, abs((control - actual) / actual) AS co FROM ({joins.PAIRS_SQL}) WHERE target = 'target_all' AND actual <> 0 AND control IS NOT NULL AND candidate IS NOT NULL)
  GROUP BY 1, 2, 3) t LEFT JOIN ratios r ON r.series_id = t.series_id AND r.ts = t.origin""")
_later = " OR ".join(f"(f.to_fold = '{to}' AND s.fold_id IN ({', '.join(repr(f) for f in ORDER[:i])}))" for i, to in enumerate(ORDER) if i)
GATE_SQL = {
    "gt": f"SELECT f.to_fold, s.* FROM shapes s JOIN (SELECT unnest({ORDER[1:]}) AS to_fold) f ON {_later}",
    **logistic_sql("gate", "gt", ["to_fold"], GATE_XS, "y"),
    "gp": f"SELECT x.fold_id, x.series_id, x.origin, x.y, {chance_sql(GATE_XS)} AS p FROM shapes x JOIN gate_fit m ON m.to_fold = x.fold_id",
}


def gate_rows(spark, d):
    """Per origin: how the two forecasts disagree, the low-level ratio, and whether the candidate won."""
    p = joins.pairs(spark, d).filter("target = 'target_all' AND control IS NOT NULL AND candidate IS NOT NULL")
    shape = metrics.trajectory_shape(p, ["fold_id", *KEYS, "origin"]).withColumnRenamed("candidate_wins", "y")
    ratio = ev.ratios(spark, d).select(*KEYS, F.col("ts").alias("origin"), "ratio")
    return cut(join_keys(shape.select("fold_id", *KEYS, "origin", *GATE_XS[:2], "y"), ratio, [*KEYS, "origin"], "left"))


def gate(spark, d):
    """Gate probability of every origin outside the first fold, by a fit on strictly earlier folds."""
    x = gate_rows(spark, d)
    model = logistic.fit_logistic(logistic.earlier_folds(x, "fold_id", ORDER, "to_fold"), ["to_fold"], GATE_XS, "y")
    scored = logistic.logistic_probability(x, model.withColumnRenamed("to_fold", "fold_id"), ["fold_id"], GATE_XS)
    return scored.filter(F.col("fold_id").isin(ORDER[1:])), model


@query("m6_expert_gate", f"fold_id:s, fit_rows:i, positives:i, intercept:d, {', '.join(f'scaled_{x}:d' for x in GATE_XS)}, rows:i, positive_rows:i, mean_probability:d, roc_auc:d, average_precision:d",
       sql(f"""SELECT m.to_fold AS fold_id, m.fit_rows, m.positives, m.intercept, {', '.join(f'm.scaled_{x}' for x in GATE_XS)}, b.rows, b.positive_rows, b.alert_rate AS mean_probability, b.roc_auc, b.average_precision
FROM gate_fit m JOIN ({binary_sql("(SELECT fold_id, p, y, p AS alert FROM gp WHERE p IS NOT NULL)", "fold_id")}) b ON b.fold_id = m.to_fold""", "shapes", **GATE_SQL))
def expert_gate(spark, d):
    """Which of two forecasts wins an origin: fitted on earlier folds only, scored on the next."""
    p, model = gate(spark, d)
    p = cut(p.filter("probability IS NOT NULL").withColumn("alert", F.lit(0)))
    scores = metrics.binary_scores(p, ["fold_id"], "probability", "y", "alert")
    mean = p.groupBy("fold_id").agg(F.avg("probability").alias("mean_probability"))
    return join_keys(join_keys(model.withColumnRenamed("to_fold", "fold_id"), scores, ["fold_id"]), mean, ["fold_id"])


@query("h6_soft_gate", "fold_id:s, series_id:s, origin:t, target:s, horizon_minutes:i, control:d, candidate:d, probability:d, gated:d",
       sql("""SELECT p.*, g.p AS probability, CASE WHEN g.p IS NULL OR candidate IS NULL THEN control ELSE control + g.p * (candidate - control) END AS gated
FROM (SELECT * FROM p WHERE target = 'target_all') p LEFT JOIN gp g ON g.fold_id = p.fold_id AND g.series_id = p.series_id AND g.origin = p.origin""", "shapes", p=joins.PAIRS_SQL, **GATE_SQL))
def soft(spark, d):
    """Control moved towards the candidate by the gate's fitted probability; a cell without one keeps the control."""
    p, _ = gate(spark, d)
    cells = joins.pairs(spark, d).filter("target = 'target_all'")
    x = join_keys(cells, p.select("fold_id", *KEYS, "origin", "probability"), ["fold_id", *KEYS, "origin"], "left")
    gated = blend.soft_gate(F.col("control"), F.col("candidate"), F.col("probability"))
    return x.withColumn("gated", F.when(F.col("probability").isNull() | F.col("candidate").isNull(), F.col("control")).otherwise(gated))


# --- domain similarity ---------------------------------------------------------------------------

DOMAIN_SQL = {
    "dr": f"SELECT *, CASE WHEN origin > TIMESTAMP '{DOMAIN_END}' THEN 1 ELSE 0 END AS y, 0 AS g, series_id || '/' || strftime(CAST(origin AS DATE), '%Y-%m-%d') AS day FROM states",
    "dd": f"""SELECT day, (row_number() OVER (PARTITION BY c ORDER BY h) - 1) % {DAY_FOLDS} AS fold FROM (SELECT day, max(y) AS c, ('0x' || substr(md5(day || '/17'), 1, 13))::BIGINT AS h FROM dr GROUP BY day)""",
    "df": "SELECT dr.*, dd.fold FROM dr JOIN dd USING (day)",
    "dt": f"SELECT h.held, df.* FROM df JOIN (SELECT unnest(range({DAY_FOLDS})) AS held) h ON h.held <> df.fold",
}
_whole, _held = logistic_sql("dw", "dr", ["g"], XS, "y"), logistic_sql("dh", "dt", ["held"], XS, "y")
OOF_SQL = {"oof": f"SELECT x.*, {chance_sql(XS)} AS p FROM df x JOIN dh_fit m ON m.held = x.fold"}


def domain_rows(spark, d):
    x = stage(spark, d, "states", lambda: state_rows(spark, d))
    x = x.withColumn("y", (F.col("origin") > F.lit(DOMAIN_END).cast("timestamp_ntz")).cast("int"))
    return x.withColumn("day", F.concat_ws("/", "series_id", F.to_date("origin").cast("string")))


@query("m6_domain_similarity", "feature:s, coefficient:d", sql(" UNION ALL ".join(f"SELECT '{x}' AS feature, scaled_{x} AS coefficient FROM dw_fit" for x in XS), "states", **DOMAIN_SQL, **_whole))
def domain(spark, d):
    """Train-versus-test classifier; its standardised coefficients say what drifted."""
    model = logistic.fit_logistic(domain_rows(spark, d).withColumn("g", F.lit(0)), ["g"], XS, "y")
    items = F.array(*[F.struct(F.lit(x).alias("feature"), F.col(f"scaled_{x}").alias("coefficient")) for x in XS])
    return model.select(F.inline(items))


@query("m6_domain_out_of_fold", "fold:i, y:i, rows:i, mean_probability:d, roc_auc:d",
       sql("""SELECT fold, y, count(*) AS rows, avg(p) AS mean_probability, max(a.roc_auc) AS roc_auc FROM oof, (SELECT (sum(y * (below + (same + 1) / 2.0)) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0) AS roc_auc
  FROM (SELECT y, rank() OVER (ORDER BY p) - 1 AS below, count(*) OVER (PARTITION BY p) AS same FROM oof)) a GROUP BY 1, 2""", "states", **DOMAIN_SQL, **_held, **OOF_SQL))
def domain_out_of_fold(spark, d):
    """Every row scored by the fit on the other day folds, and the pooled AUC of those probabilities."""
    x = cut(splits.grouped_folds(domain_rows(spark, d), "day", "y", DAY_FOLDS, 17))
    p = cut(logistic.out_of_fold(x, "fold", range(DAY_FOLDS), XS, "y").withColumn("g", F.lit(0)))
    from tidegrid.operators.ordering import rank_auc
    auc = rank_auc(p, ["g"], "probability", "y", "roc_auc").select("g", "roc_auc")
    table = p.groupBy("g", "fold", "y").agg(F.count(F.lit(1)).alias("rows"), F.avg("probability").alias("mean_probability"))
    return join_keys(table, auc, ["g"])
