"""Fits that reduce to sums: every (fold, target, horizon) in one aggregate."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidegrid.functions.numeric import clip
from tidegrid.operators.ordering import quantile_columns
from tidegrid.operators.sizing import join_keys, keyed_join, lookup_join
from tidegrid.session import cut


def gram_sums(df: DataFrame, keys: Sequence[str], xs: Sequence[str], y: str, weight: str | None = None) -> DataFrame:
    """Means and centred second moments per group, map-side combined: ``keys, _means, _covs, fit_rows``.

    Partial moments are merged around their own means, so a column far from zero keeps its digits. Weighted
    moments take the weighted means first and centre on them in a second pass.
    """
    keys, cols = list(keys), [*xs, y]
    complete = df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols]))
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    x = lambda i: F.col(cols[i]).cast("double")
    count = F.count(F.lit(1)).alias("fit_rows")
    if weight is None:
        return complete.groupBy(*keys).agg(F.array(*[F.avg(x(i)) for i in range(len(cols))]).alias("_means"),
                                           F.array(*[F.var_pop(x(i)) if i == j else F.covar_pop(x(i), x(j)) for i, j in pairs]).alias("_covs"), count)
    w = F.col(weight)
    means = complete.groupBy(*keys).agg(F.array(*[F.sum(w * x(i)) / F.sum(w) for i in range(len(cols))]).alias("_means"))
    apart = lambda i: x(i) - F.element_at("_means", i + 1)
    return lookup_join(complete, means, keys).groupBy(*keys).agg(
        F.first("_means").alias("_means"), F.array(*[F.sum(w * apart(i) * apart(j)) / F.sum(w) for i, j in pairs]).alias("_covs"), count)


def solve_grams(grams: DataFrame, keys: Sequence[str], xs: Sequence[str]) -> DataFrame:
    """Minimum-norm least squares on each group's moments (at most one small matrix per group)."""
    p = len(xs)
    schema = grams.select(*keys, "fit_rows").schema.simpleString()[7:-1].replace(":", " ")
    columns = ", ".join(f"`beta_{x}` double, `scaled_{x}` double" for x in xs)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        for pdf in batches:
            rows = []
            for means, covs in zip(pdf["_means"], pdf["_covs"]):
                m = np.zeros((p + 1, p + 1))
                m[np.triu_indices(p + 1)] = np.asarray(covs, dtype=float)
                m = m + np.triu(m, 1).T
                mean, cov, cxy = np.asarray(means, dtype=float), m[:p, :p], m[:p, p]
                std = np.sqrt(np.clip(np.diag(cov), 0.0, None))
                scale = np.where(std > 1e-12, std, 1.0)
                scaled = np.linalg.pinv(cov / np.outer(scale, scale), rcond=1e-10, hermitian=True) @ (cxy / scale)
                beta = scaled / scale
                rows.append([mean[p] - beta @ mean[:p], *[v for pair in zip(beta, scaled) for v in pair]])
            out = pdf.drop(columns=["_means", "_covs"]).copy()
            names = ["intercept", *[f"{k}_{x}" for x in xs for k in ("beta", "scaled")]]
            for i, name in enumerate(names):
                out[name] = [r[i] for r in rows]
            yield out

    return grams.select(*keys, "fit_rows", "_means", "_covs").mapInPandas(
        run, schema=f"{schema}, intercept double, {columns}")


def fit_linear(df: DataFrame, keys: Sequence[str], xs: Sequence[str], y: str, weight: str | None = None) -> DataFrame:
    return solve_grams(gram_sums(df, keys, xs, y, weight), keys, xs)


def linear_value(xs: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(f"beta_{x}") * F.col(x) for x in xs], F.col("intercept"))


def predict_linear(df: DataFrame, model: DataFrame, keys: Sequence[str], xs: Sequence[str], out: str,
                   floor: float | None = 0.0) -> DataFrame:
    """Score rows with the coefficients of their group; a missing input gives NULL."""
    names = ["intercept", *[f"beta_{x}" for x in xs]]
    if keys:
        joined = lookup_join(df, model.select(*keys, *names), keys)
    else:
        row = model.select(*names).first()   # one fit: its few numbers become literals
        joined = df.withColumns({n: F.lit(row[n]) for n in names})
    value = linear_value(xs)
    return joined.withColumn(out, value if floor is None else clip(value, floor)).drop(*names)


def fill_medians(train: DataFrame, apply_to: DataFrame, keys: Sequence[str], xs: Sequence[str]) -> DataFrame:
    """Replace missing inputs by the median of the group's training rows."""
    keys = list(keys)
    cells = train.unpivot(keys, list(xs), "_x", "_value")
    med = quantile_columns(cells, [*keys, "_x"], "_value", {"_m": 0.5})
    wide = med.groupBy(*keys).agg(*[F.max(F.when(F.col("_x") == x, F.col("_m"))).alias(f"_m_{x}") for x in xs])
    joined = lookup_join(apply_to, wide, keys)
    return joined.withColumns({x: F.coalesce(x, f"_m_{x}") for x in xs}).drop(*[f"_m_{x}" for x in xs])


def fit_weighted_l1(df: DataFrame, xs: Sequence[str], y: str, weight: str, rounds: int = 20,
                    ridge: float = 1e-6) -> DataFrame:
    """Weighted absolute-error line by iteratively reweighted sums.

    Each round is one aggregate over the data; only the moments of one fit, a fixed handful of
    numbers, return between rounds.
    """
    keys = ["_fit"]
    base = df.withColumn("_fit", F.lit(0))
    model = fit_linear(base, keys, xs, y, weight)
    for _ in range(rounds):
        row = model.collect()[0]
        value = reduce(lambda a, b: a + b, [F.lit(row[f"beta_{x}"]) * F.col(x) for x in xs], F.lit(row["intercept"]))
        again = base.withColumn("_w", F.col(weight) / F.greatest(F.abs(F.col(y) - value), F.lit(ridge)))
        model = fit_linear(again, keys, xs, y, "_w")
    return model.drop("_fit")


def robust_scaler(train: DataFrame, keys: Sequence[str], xs: Sequence[str], floor: float = 1e-6) -> DataFrame:
    """Median and floored IQR per group and column, taken on median-filled training rows: ``keys, column, center, scale``."""
    keys = list(keys)
    cells = train.unpivot(keys, list(xs), "column_name", "_value")
    center = cut(quantile_columns(cells, [*keys, "column_name"], "_value", {"center": 0.5}).drop("n_values"))
    filled = keyed_join(cells, center, [*keys, "column_name"]).withColumn(
        "_filled", F.coalesce("_value", "center"))
    iqr = quantile_columns(filled, [*keys, "column_name"], "_filled", {"_a": 0.25, "_b": 0.75}).drop("n_values")
    return join_keys(center, iqr, [*keys, "column_name"]).select(
        *keys, "column_name", "center", F.greatest(F.col("_b") - F.col("_a"), F.lit(floor)).alias("scale"))


def apply_scaler(df: DataFrame, scaler: DataFrame, keys: Sequence[str], xs: Sequence[str]) -> DataFrame:
    keys = list(keys)
    pick = lambda x, c: F.max(F.when(F.col("column_name") == x, F.col(c)))
    wide = scaler.groupBy(*keys).agg(*[e for x in xs for e in (pick(x, "center").alias(f"_c_{x}"),
                                                              pick(x, "scale").alias(f"_s_{x}"))])
    joined = lookup_join(df, wide, keys)
    return joined.withColumns({x: (F.coalesce(x, f"_c_{x}") - F.col(f"_c_{x}")) / F.col(f"_s_{x}") for x in xs}).drop(
        *[f"_{k}_{x}" for x in xs for k in ("c", "s")])


def fit_log_scale(df: DataFrame, keys: Sequence[str], y: str, floor: float = 1e-6) -> DataFrame:
    """Mean and population deviation of the logarithm per horizon."""
    log = F.when(F.col(y) > 0, F.ln(y))
    return df.groupBy(*keys).agg(F.avg(log).alias("log_mean"),
                                 F.greatest(F.stddev_pop(log), F.lit(floor)).alias("log_std"))


def to_log_scale(y: str) -> Column:
    return (F.when(F.col(y) > 0, F.ln(y)) - F.col("log_mean")) / F.col("log_std")


def from_log_scale(z: Column, low: float, high: float) -> Column:
    return clip(F.exp(z * F.col("log_std") + F.col("log_mean")), low, high)


def fit_profile(df: DataFrame, keys: Sequence[str], ts: str, value: str, slot: Column) -> DataFrame:
    """Medians by (weekday, slot), by slot and overall: ``keys, level, dow, slot, median``.

    One grouping-set expansion feeds the exact distributed quantile; the table has a fixed number
    of rows per group (8 * slots + 1).
    """
    base = df.filter(F.col(value).isNotNull()).select(*keys, F.weekday(ts).alias("dow"), slot.alias("slot"),
                                                     F.col(value).alias("_v"))
    none = F.lit(-1)
    levels = F.array(*[F.struct(F.lit(n).alias("level"), d.alias("dow"), s.alias("slot"))
                       for n, d, s in (("dow_slot", F.col("dow"), F.col("slot")), ("slot", none, F.col("slot")),
                                       ("overall", none, none))])
    spread = base.select(*keys, "_v", F.explode(levels).alias("_l")).select(*keys, "_v", "_l.*")
    return quantile_columns(spread, [*keys, "level", "dow", "slot"], "_v", {"median": 0.5})


def lookup_profile(cells: DataFrame, profile: DataFrame, keys: Sequence[str], ts: str, slot: Column, out: str) -> DataFrame:
    """(weekday, slot) median, else slot median, else overall."""
    keys = list(keys)
    table = cut(profile)
    part = lambda level, name, cols: table.filter(F.col("level") == level).select(
        *keys, *cols, F.col("median").alias(name))
    x = cells.withColumns({"dow": F.weekday(ts), "slot": slot})
    x = keyed_join(x, part("dow_slot", "_a", ["dow", "slot"]), [*keys, "dow", "slot"], "left")
    x = keyed_join(keyed_join(x, part("slot", "_b", ["slot"]), [*keys, "slot"], "left"), part("overall", "_c", []), keys, "left")
    return x.withColumn(out, F.coalesce("_a", "_b", "_c")).drop("_a", "_b", "_c", "dow", "slot")


def boundary_contract(history: DataFrame, keys: Sequence[str], level: str, deltas: Sequence[str], balance: str, *,
                      reference: tuple[float, float], zone: tuple[float, float], floor: float) -> DataFrame:
    """Reference and zone quantiles, medians and floored IQR scales from history rows only."""
    lo, hi = reference
    zl, zh = zone
    if not 0 <= lo < zl < zh < hi <= 1:
        raise ValueError("quantiles must be strictly ordered")
    keys = list(keys)
    names = [level, *deltas, balance]
    cells = history.unpivot(keys, names, "_x", "_value")
    q = quantile_columns(cells, [*keys, "_x"], "_value",
                         {"lo": lo, "zl": zl, "zh": zh, "hi": hi, "q25": 0.25, "q50": 0.5, "q75": 0.75})
    at = lambda x, c: F.max(F.when(F.col("_x") == x, F.col(c)))
    scale = lambda x: F.greatest(at(x, "q75") - at(x, "q25"), F.lit(floor))
    table = q.groupBy(*keys).agg(
        at(level, "lo").alias("reference_low"), at(level, "zl").alias("zone_low"), at(level, "zh").alias("zone_high"),
        at(level, "hi").alias("reference_high"), at(level, "q50").alias("level_median"),
        *[scale(d).alias(f"{d}_scale") for d in deltas], at(balance, "q50").alias("balance_median"),
        scale(balance).alias("balance_scale"))
    span = F.col("reference_high") - F.col("reference_low")
    wide = F.assert_true(span > floor, F.lit("reference span is degenerate")).isNull()
    return table.withColumn("reference_span", F.when(wide, span))
