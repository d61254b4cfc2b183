"""Logistic regressions of all groups at once: damped Newton steps on weighted sums.

A fit is of one group (fold, horizon, validation block). Every round reads the standardised rows once,
joined with the few numbers of their group's present step, and one map-side combined aggregate gives the
loss, gradient and curvature of all groups. Steps are solved per group from that one row of sums; a
step that raises the loss is halved. Groups that have converged leave the join. Nothing but the question
whether any group is left returns to the driver, and each round's table is written, so a lost executor costs one
re-read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidegrid.operators.ordering import quantile_columns
from tidegrid.operators.sizing import lookup_join
from tidegrid.session import cut

RIDGE, TOLERANCE, ROUNDS = 0.01, 1e-10, 60
FLAT = 1e-12   # a column with less deviation teaches nothing


def standardised(train: DataFrame, keys: Sequence[str], xs: Sequence[str], y: str, weight: str | None) -> tuple[DataFrame, DataFrame]:
    """Rows (keys, _z0.., _y, _w) and per group what was done to them: median, mean and deviation of every input.

    Missing inputs take the median of the group's training rows, 0 where there is none.
    """
    keys = list(keys)
    cells = train.unpivot(keys, list(xs), "_x", "_value")
    med = quantile_columns(cells, [*keys, "_x"], "_value", {"_m": 0.5})
    med = med.groupBy(*keys).agg(*[F.max(F.when(F.col("_x") == x, F.col("_m"))).alias(f"median_{x}") for x in xs])
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = train.filter(F.col(y).isNotNull()).select(*keys, *[F.col(x).cast("double").alias(x) for x in xs], F.col(y).cast("double").alias("_y"), w.alias("_w"))
    rows = lookup_join(rows, med, keys, "left").withColumns({f"median_{x}": F.coalesce(f"median_{x}", F.lit(0.0)) for x in xs})
    rows = cut(rows.withColumns({x: F.coalesce(F.nanvl(x, F.lit(None).cast("double")), f"median_{x}") for x in xs}))
    moments = [e for x in xs for e in (F.max(f"median_{x}").alias(f"median_{x}"), F.avg(x).alias(f"mean_{x}"), F.stddev_pop(x).alias(f"deviation_{x}"))]
    scale = rows.groupBy(*keys).agg(*moments, F.count(F.lit(1)).alias("fit_rows"), F.sum("_y").cast("bigint").alias("positives"))
    scale = cut(scale.withColumns({f"deviation_{x}": F.when(F.col(f"deviation_{x}") > FLAT, F.col(f"deviation_{x}")).otherwise(1.0) for x in xs}))
    both = scale.filter((F.col("positives") > 0) & (F.col("positives") < F.col("fit_rows")))
    z = [((F.col(x) - F.col(f"mean_{x}")) / F.col(f"deviation_{x}")).alias(f"_z{i}") for i, x in enumerate(xs)]
    return cut(lookup_join(rows.drop(*[f"median_{x}" for x in xs]), both, keys).select(*keys, *z, "_y", "_w")), scale


def fit_logistic(train: DataFrame, keys: Sequence[str], xs: Sequence[str], y: str, weight: str | None = None,
                 ridge: float = RIDGE, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per group: ``fit_rows, positives, intercept, beta_x, scaled_x, median_x, gradient, rounds``.

    Minimises the mean log loss plus half of ``ridge`` times the squared coefficients of the standardised
    inputs, until no component of the gradient exceeds ``tolerance``. A group whose rows are all of one class has
    no fit: its coefficients are NULL. Raises when a group is still moving after ``ROUNDS``.
    """
    keys, p = list(keys), len(xs)
    rows, scale = standardised(train, keys, xs, y, weight)
    terms = [F.lit(1.0), *[F.col(f"_z{i}") for i in range(p)]]
    score = reduce(lambda a, b: a + b, [F.element_at("trial", i + 1) * t for i, t in enumerate(terms)])
    chance = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_score")))
    loss = F.greatest(F.col("_score"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("_score"))) - F.col("_y") * F.col("_score")
    miss, bend = F.col("_w") * (chance - F.col("_y")), F.col("_w") * chance * (1.0 - chance)
    sums = [F.sum("_w"), F.sum(F.col("_w") * loss), *[F.sum(miss * t) for t in terms],
            *[F.sum(bend * terms[i] * terms[j]) for i in range(p + 1) for j in range(i, p + 1)]]
    none = F.array(*[F.lit(0.0)] * (p + 1))
    fitted = scale.filter((F.col("positives") > 0) & (F.col("positives") < F.col("fit_rows")))
    state = cut(fitted.select(*keys, none.alias("best"), none.alias("step"), none.alias("trial"), F.lit(1.0).alias("share"), F.lit(None).cast("double").alias("loss"),
                              F.lit(None).cast("double").alias("gradient"), F.lit(0).alias("rounds"), F.lit(False).alias("done")))
    finished = []
    while not state.isEmpty():
        found = lookup_join(rows, state.select(*keys, "trial"), keys).withColumn("_score", score).groupBy(*keys).agg(F.array(*sums).alias("_sums"))
        state = cut(lookup_join(found, state, keys).select(*state.columns, "_sums").mapInPandas(_newton(p, ridge, tolerance), state.schema))
        finished.append(state.filter("done"))
        state = state.filter("NOT done")
        if len(finished) > ROUNDS and not state.isEmpty():
            raise ValueError(f"logistic fits haven't converged after {ROUNDS} rounds")
    done = reduce(lambda a, b: a.unionByName(b), finished, state)
    scaled = [F.element_at("best", i + 2) for i in range(p)]
    beta = [s / F.col(f"deviation_{x}") for s, x in zip(scaled, xs)]
    level = reduce(lambda a, b: a - b, [b * F.col(f"mean_{x}") for b, x in zip(beta, xs)], F.element_at("best", 1))
    named = [e for x, b, s in zip(xs, beta, scaled) for e in (b.alias(f"beta_{x}"), s.alias(f"scaled_{x}"), F.col(f"median_{x}"))]
    return cut(lookup_join(scale, done, keys, "left").select(*keys, "fit_rows", "positives", level.alias("intercept"), *named, "gradient", "rounds"))


def _newton(p: int, ridge: float, tolerance: float):
    def run(batches: Iterator) -> Iterator:
        import numpy as np

        upper = np.triu_indices(p + 1)
        shrink = np.full(p + 1, ridge)
        shrink[0] = 0.0
        for pdf in batches:
            rows = pdf.to_dict("records")
            for r in rows:
                sums, at = np.asarray(r.pop("_sums"), float), np.asarray(r["trial"], float)
                n = sums[0]
                loss = sums[1] / n + 0.5 * (shrink * at * at).sum()
                r["rounds"] += 1
                if np.isnan(r["loss"] if r["loss"] is not None else np.nan) or loss <= r["loss"] + 1e-12 * abs(r["loss"]):
                    gradient = sums[2:p + 3] / n + shrink * at
                    curve = np.zeros((p + 1, p + 1))
                    curve[upper] = sums[p + 3:] / n
                    curve = curve + np.triu(curve, 1).T + np.diag(shrink)
                    step = -np.linalg.lstsq(curve, gradient, rcond=None)[0]
                    r.update(best=at.tolist(), step=step.tolist(), share=1.0, loss=float(loss), gradient=float(np.abs(gradient).max()), trial=(at + step).tolist())
                    r["done"] = r["gradient"] <= tolerance
                else:
                    r["share"] /= 2
                    r["trial"] = (np.asarray(r["best"], float) + r["share"] * np.asarray(r["step"], float)).tolist()
                    # No representable step is left: the gradient kept tells how far it came.
                    r["done"] = r["share"] < 1e-12
            yield pdf.__class__(rows, columns=[c for c in pdf.columns if c != "_sums"])
    return run


def logistic_probability(rows: DataFrame, model: DataFrame, keys: Sequence[str], xs: Sequence[str], out: str = "probability") -> DataFrame:
    """Chance of class one by the fit of each row's group; NULL where the group has none."""
    names = ["intercept", *[f"{k}_{x}" for x in xs for k in ("beta", "median")]]
    joined = lookup_join(rows, model.select(*keys, *names), list(keys), "left")
    value = lambda x: F.coalesce(F.nanvl(F.col(x).cast("double"), F.lit(None).cast("double")), f"median_{x}")
    score: Column = reduce(lambda a, b: a + b, [F.col(f"beta_{x}") * value(x) for x in xs], F.col("intercept"))
    return joined.withColumn(out, F.lit(1.0) / (F.lit(1.0) + F.exp(-score))).drop(*names)


def out_of_fold(df: DataFrame, fold: str, folds: Sequence, xs: Sequence[str], y: str, out: str = "probability", ridge: float = RIDGE) -> DataFrame:
    """Every row's chance by the fit on all other folds, which is one group of the same joint fit."""
    others = F.explode(F.filter(F.array(*[F.lit(f) for f in folds]), lambda f: f != F.col(fold)))
    model = fit_logistic(df.select(fold, *xs, y).withColumn("_held", others).drop(fold).withColumnRenamed("_held", fold), [fold], xs, y, ridge=ridge)
    return logistic_probability(df, model, [fold], xs, out)


def earlier_folds(df: DataFrame, fold: str, order: Sequence[str], out: str) -> DataFrame:
    """One copy of a row for each later fold: those that may train on it."""
    later = F.array(*[F.when(F.col(fold).isin(list(order[:i])), F.lit(f)) for i, f in enumerate(order) if i])
    return df.select("*", F.explode(F.filter(later, lambda f: f.isNotNull())).alias(out))
