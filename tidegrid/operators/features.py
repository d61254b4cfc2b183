"""Causal window features with a registry of where each one may look."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidegrid.functions.calendar import calendar_columns
from tidegrid.operators.chunks import CHUNK, windowed

REGISTRY_SCHEMA = ("feature_name string, base_signal string, transform string, "
                   "source_offset_min_minutes int, source_offset_max_minutes int, causal boolean, "
                   "diagnostic boolean")


@dataclass(frozen=True)
class Feature:
    """``build(window)`` gives the column; offsets are grid rows relative to the origin."""

    name: str
    base: str
    transform: str
    oldest: int
    newest: int
    build: Callable[..., Column]
    stage: int = 0
    diagnostic: bool = False
    needs: tuple[Feature, ...] = ()
    hidden: bool = False
    sliding: tuple[str, int, int] | None = None


def _frame(w, first: int, last: int):
    return w.rowsBetween(first, last)


def lag(signal: str, rows: int) -> Feature:
    return Feature(f"{signal}__lag_{rows}", signal, "lag", -rows, -rows, lambda w: F.lag(signal, rows).over(w))


def _finite(signal: str) -> Column:
    """The signal as a double; NULL where it isn't finite: such a value counts as missing in every feature."""
    x = F.col(signal).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def _block(signal: str, measure: str, size: int) -> str:
    return f"_{signal}__{measure}_{size}"


_SPREAD = ("n", "mean", "m2")
_FIRST = {"n": lambda x: F.when(x.isNotNull(), 1).otherwise(0), "sum": lambda x: F.coalesce(x, F.lit(0.0)), "min": lambda x: x, "max": lambda x: x,
          "mean": lambda x: F.coalesce(x, F.lit(0.0)), "m2": lambda x: F.lit(0.0)}


def _blocks(signal: str, rows: int, stage: int, measures: Sequence[str]) -> tuple[Feature, ...]:
    """Measures of a signal over the last 1, 2, 4, ... rows, each from two halves; only those that a feature asks for.

    A frame of any length is a few of these blocks side by side, so a row costs the logarithm of the
    length instead of the length, and nothing is ever subtracted: a value that isn't finite counts as
    missing, and one of any size is forgotten as soon as it leaves the frame. Features of one signal share
    their blocks by name.
    """
    hidden = lambda measure, size, build, late: Feature(_block(signal, measure, size), signal, "block", 0, 0, build, stage + late, hidden=True)
    out = [hidden(c, 1, lambda w, c=c: _FIRST[c](_finite(signal)), 0) for c in measures]
    size, late = 1, 1
    while 2 * size <= rows:
        for c in measures:
            def build(w, c=c, size=size):
                near = lambda k: F.col(_block(signal, k, size))
                far = lambda k: F.lag(_block(signal, k, size), size, None if k in ("min", "max") else 0).over(w)
                if c in ("mean", "m2"):
                    return _merge({k: near(k) for k in _SPREAD}, {k: far(k) for k in _SPREAD})[c]
                return {"n": near(c) + far(c), "sum": near(c) + far(c)}[c] if c in ("n", "sum") else (F.least if c == "min" else F.greatest)(near(c), far(c))
            out.append(hidden(c, 2 * size, build, late))
        size, late = 2 * size, late + 1
    return tuple(out)


def _merge(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """Moments of two disjoint sets of rows together."""
    n = a["n"] + b["n"]
    apart = b["mean"] - a["mean"]
    empty = (a["n"] == 0) | (b["n"] == 0)
    mean = F.when(a["n"] == 0, b["mean"]).when(b["n"] == 0, a["mean"]).otherwise(a["mean"] + apart * b["n"] / n)
    m2 = F.when(empty, a["m2"] + b["m2"]).otherwise(a["m2"] + b["m2"] + apart * apart * (a["n"] * b["n"] / n))
    return {"n": n, "mean": mean, "m2": m2}


def _parts(signal: str, rows: int, newest: int, measures: Sequence[str], w) -> list[dict[str, Column]]:
    """The blocks that make up a frame of ``rows`` rows ending at ``newest``."""
    out, at, size = [], -newest, 1 << (rows.bit_length() - 1)
    while rows:
        if size <= rows:
            out.append({c: F.lag(_block(signal, c, size), at, 0).over(w) if at else F.col(_block(signal, c, size)) for c in measures})
            at, rows = at + size, rows - size
        size //= 2
    return out


def _total(parts: list[dict[str, Column]], measure: str) -> Column:
    return sum((p[measure] for p in parts[1:]), parts[0][measure])


def _from_blocks(signal: str, rows: int, newest: int, kind: str, minimum: int) -> Callable[..., Column]:
    def build(w):
        parts = _parts(signal, rows, newest, _MEASURES[kind], w)
        n = _total(parts, "n")
        if kind in ("min", "max"):
            # Two blocks that overlap cover the frame.
            size = 1 << (rows.bit_length() - 1)
            ends = [F.lag(_block(signal, kind, size), at).over(w) if at else F.col(_block(signal, kind, size)) for at in {-newest, rows - size - newest}]
            value = ends[0] if len(ends) == 1 else (F.least if kind == "min" else F.greatest)(*ends)
        elif kind == "median":
            value = F.col(_sliding_name(signal, rows, newest))
        elif kind in ("mean", "sum"):
            value = _total(parts, "sum") / n if kind == "mean" else _total(parts, "sum")
        else:
            # Deviations from the mean of the whole frame; parts of equal constant values add exactly 0.
            mean = _total(parts, "sum") / n
            held = [F.when(p["n"] > 0, p["mean"]) for p in parts]
            same = F.greatest(*held) == F.least(*held) if len(parts) > 1 else F.lit(True)
            apart = [(p["mean"] - mean) * (p["mean"] - mean) * p["n"] for p in parts]
            spread = _total(parts, "m2") + F.when(same, 0.0).otherwise(sum(apart[1:], apart[0]))
            value = F.sqrt(spread / n) if kind == "std_pop" else F.when(n > 1, F.sqrt(spread / (n - 1)))
        return F.when((n >= minimum) & (n > 0), value)
    return build


_MEASURES = {"mean": ("n", "sum"), "sum": ("n", "sum"), "std_pop": ("n", "sum", "mean", "m2"), "std_samp": ("n", "sum", "mean", "m2"),
             "min": ("n", "min"), "max": ("n", "max"), "median": ("n",)}


def _sliding_name(signal: str, rows: int, newest: int) -> str:
    return f"_{signal}__median_{rows}_{-newest}"


def _sliding_median(signal: str, rows: int, newest: int) -> Feature:
    """The exact median of the finite values of a frame; taken in one pass along each chunk before all windows."""
    return Feature(_sliding_name(signal, rows, newest), signal, "sliding_median", newest - rows + 1, newest, lambda w: None, hidden=True, sliding=(signal, rows, newest))


def sliding_medians(df: DataFrame, keys: Sequence[str], ts: str, wanted: Sequence[Feature]) -> DataFrame:
    """Median columns of the chunks of ``with_halo``: one ordered pass each, a skip list per frame.

    A row enters and leaves a sorted structure, so it costs the logarithm of the frame. Chunks are tasks of
    bounded size, on the partitioning that the windows after it use.
    """
    def run(table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by(ts)
        for f in wanted:
            signal, rows, newest = f.sliding
            x = table[signal].cast(pa.float64()).to_pandas()
            x = x.where(np.isfinite(x)).rolling(rows, min_periods=1).median().shift(-newest)
            table = table.append_column(f.name, pa.array(x, pa.float64(), from_pandas=True))
        return table

    schema = StructType([*df.schema, *(StructField(f.name, DoubleType()) for f in wanted)])
    return df.groupBy(*keys, CHUNK).applyInArrow(run, schema)


def rolling(signal: str, rows: int, kind: str, minimum: int | None = None, fraction: float | None = None,
            newest: int = 0, label: str | None = None, stage: int = 0) -> Feature:
    """Trailing ``mean``, ``std_pop``, ``std_samp``, ``min``, ``max``, ``sum`` or ``median`` of ``rows`` grid rows.

    Needs ``minimum`` observed values, or ``ceil(fraction * rows)``, or by default all of them. Values that
    are not finite count as missing. No kind costs a row more than the logarithm of the frame's length.
    """
    if fraction is not None:
        minimum = math.ceil(fraction * rows)
    minimum = rows if minimum is None else minimum
    name = label or f"{signal}__{kind}_{rows}"
    needs = _blocks(signal, rows, stage, _MEASURES[kind])
    if kind == "median":
        if stage:
            raise ValueError("a sliding median is taken of a signal itself, not of another feature")
        needs += (_sliding_median(signal, rows, newest),)
    return Feature(name, signal, f"rolling_{kind}", newest - rows + 1, newest, _from_blocks(signal, rows, newest, kind, minimum), stage + rows.bit_length(), needs=needs)


def missing_fraction(signal: str, rows: int) -> Feature:
    """Share of the last ``rows`` grid rows, or as many as there are, without a finite value."""
    def build(w):
        size = F.least(F.row_number().over(w), F.lit(rows))
        return (size - _total(_parts(signal, rows, 0, ("n",), w), "n")) / size
    return Feature(f"{signal}__missing_fraction_{rows}", signal, "missing_fraction", -rows + 1, 0, build, rows.bit_length(), needs=_blocks(signal, rows, 0, ("n",)))


def difference(signal: str, rows: int) -> Feature:
    return Feature(f"{signal}__diff_{rows}", signal, "difference", -rows, 0,
                   lambda w: F.col(signal) - F.lag(signal, rows).over(w))


def mean_difference(signal: str, rows: int, minimum: int = 1) -> tuple[Feature, Feature]:
    """First difference and the trailing mean of it: two chained frames."""
    first = difference(signal, 1)
    smooth = rolling(first.name, rows, "mean", minimum, stage=1)
    return first, replace(smooth, name=f"{signal}__mean_diff_{rows}", base=signal, transform="mean_difference",
                          oldest=-rows)


def window_delta(signal: str, rows: int, floor: float = 1e-9) -> tuple[Feature, Feature]:
    """Recent minus previous full-window mean, absolute and relative to the previous one."""
    mean = replace(rolling(signal, rows, "mean"), name=f"_{signal}__full_{rows}", hidden=True)
    before = lambda w: F.lag(mean.name, rows).over(w)
    scale = lambda w: F.greatest(F.abs(before(w)), F.lit(floor))
    late = mean.stage + 1
    return (Feature(f"{signal}__delta_{rows}", signal, "window_delta", -2 * rows + 1, 0,
                    lambda w: F.col(mean.name) - before(w), late, needs=(mean,)),
            Feature(f"{signal}__relative_delta_{rows}", signal, "relative_window_delta", -2 * rows + 1, 0,
                    lambda w: F.when(before(w).isNotNull(), (F.col(mean.name) - before(w)) / scale(w)), late, needs=(mean,)))


def level_vs_baseline(signal: str, recent_rows: int, baseline_rows: int, minimum: int,
                      floor: float = 1e-9) -> Feature:
    """Recent full-window mean over the rolling median of a long baseline, minus one."""
    recent, median = rolling(signal, recent_rows, "mean"), rolling(signal, baseline_rows, "median", minimum)

    def build(w):
        base = median.build(w)
        return recent.build(w) / F.when(base.isNotNull(), F.greatest(F.abs(base), F.lit(floor))) - 1.0
    return Feature(f"{signal}__level_vs_{baseline_rows}", signal, "level_vs_baseline",
                   -max(recent_rows, baseline_rows) + 1, 0, build, max(recent.stage, median.stage), needs=(*recent.needs, *median.needs))


def low_level_ratio(signal: str, short_rows: int, baseline_rows: int, minimum: int,
                    name: str = "low_level_ratio") -> tuple[Feature, Feature]:
    """Smoothed level divided by its own trailing mean."""
    smooth = rolling(signal, short_rows, "mean", 1, label=f"{name}__smooth")
    base = rolling(smooth.name, baseline_rows, "mean", minimum, label=f"{name}__baseline", stage=smooth.stage + 1)
    baseline = replace(base, hidden=True)
    ratio = lambda w: F.when(F.col(baseline.name) != 0, F.col(smooth.name) / F.col(baseline.name))
    return smooth, Feature(name, signal, "low_level_ratio", -(short_rows + baseline_rows - 2), 0, ratio,
                           baseline.stage + 1, needs=(baseline,))


def co_direction(a: str, b: str, step_rows: int, rows: int) -> tuple[Feature, Feature, Feature]:
    """Share of recent rows in which two signals moved the same way."""
    da, db = difference(a, step_rows), difference(b, step_rows)
    same = lambda: (F.col(da.name) * F.col(db.name) > 0).cast("double")
    return da, db, Feature(f"{a}__{b}__co_direction", f"{a}|{b}", "co_direction", -(rows - 1 + step_rows), 0,
                           lambda w: F.avg(F.coalesce(same(), F.lit(0.0))).over(_frame(w, -rows + 1, 0)), 1)


def shifted_label(signal: str, rows: int = 1) -> Feature:
    """Latest complete interval before the origin; needs true target history, so diagnostic."""
    return Feature(f"{signal}__previous_interval", signal, "target_history", -rows, -rows,
                   lambda w: F.lag(signal, rows).over(w), diagnostic=True)


def recent_lags(signals: Sequence[str], lags: Sequence[int], means: Sequence[int]) -> list[Feature]:
    """Current value, lags and full-window means of several signals."""
    out: list[Feature] = []
    for s in signals:
        out.append(Feature(f"{s}__current", s, "current", 0, 0, lambda w, s=s: F.col(s)))
        out += [lag(s, k) for k in lags] + [rolling(s, k, "mean") for k in means]
    return out


def dwell(zone: str, cap: int, name: str) -> tuple[Feature, Feature]:
    """Consecutive rows in a 0/1 zone up to now, at most ``cap``: rows since the last one outside."""
    spot = Feature(f"{name}__row", zone, "row_position", 0, 0, lambda w: F.row_number().over(w))
    outside = lambda: F.max(F.when(F.col(zone) == 0, F.col(spot.name)))
    size = lambda w: F.count(F.lit(1)).over(_frame(w, -cap + 1, 0))
    gap = lambda w: F.col(spot.name) - outside().over(_frame(w, -cap + 1, 0))
    return spot, Feature(name, zone, "dwell", -cap + 1, 0, lambda w: F.coalesce(gap(w), size(w)).cast("int"), 1)


def sequence_window(df: DataFrame, keys: Sequence[str], ts: str, columns: Sequence[str], rows: int, step: int,
                    out: str = "window_values") -> DataFrame:
    """The last ``rows`` grid rows of every origin as an array of structs; incomplete ones are dropped."""
    item = F.struct(*[F.col(c) for c in columns])
    built = windowed(df, keys, ts, [lambda w: {out: F.collect_list(item).over(_frame(w, -rows + 1, 0))}],
                     back=rows * step)
    return built.filter(F.size(out) == rows)


def build_features(df: DataFrame, keys: Sequence[str], ts: str, step: int, features: Iterable[Feature],
                   chunk: int | None = None, rows: int | None = None) -> DataFrame:
    """All features of a complete grid in one exchange and one sort; ``rows``, if known, sets the number of tasks."""
    wanted: dict[str, Feature] = {}

    def visit(f: Feature) -> None:
        for n in f.needs:
            visit(n)
        wanted.setdefault(f.name, f)

    for f in features:
        visit(f)
    ordered = [f for f in wanted.values() if f.sliding]
    plan = [f for f in wanted.values() if not f.sliding]
    stages = sorted({f.stage for f in plan})
    # Chained frames add up; a feature of a late stage already states its whole reach.
    reach = max((-f.oldest for f in wanted.values()), default=0) + sum(
        max((-f.oldest for f in plan if f.stage == s), default=0) for s in stages[:-1])
    build = [lambda w, s=s: {f.name: f.build(w) for f in plan if f.stage == s} for s in stages]
    prepare = (lambda x: sliding_medians(x, keys, ts, ordered)) if ordered else None
    out = windowed(df, keys, ts, build, back=reach * step, length=chunk, prepare=prepare, rows=rows)
    return out.drop(*[f.name for f in wanted.values() if f.hidden])


def registry(spark: SparkSession, features: Iterable[Feature], step: int, calendar: bool = False,
             indicators: Sequence[str] = ()) -> DataFrame:
    """One row per feature with its source range in minutes."""
    rows = [(f.name, f.base, f.transform, f.oldest * step, f.newest * step, f.newest <= 0, f.diagnostic)
            for f in features]
    if calendar:
        rows += [(n, "calendar", "calendar", 0, 0, True, False) for n in calendar_columns(F.lit(None).cast(
            "timestamp_ntz"), "origin_")]
    rows += [(n, n, "current_state_indicator", 0, 0, True, False) for n in indicators]
    return spark.createDataFrame(rows, REGISTRY_SCHEMA)


def select_features(reg: DataFrame, signals: Sequence[str], transforms: Sequence[str], *,
                    calendar: bool = False, indicators: bool = False) -> DataFrame:
    """Registry rows declared by signal and transform; refuses non-causal entries."""
    kinds = (["calendar"] if calendar else []) + (["current_state_indicator"] if indicators else [])
    chosen = (F.col("base_signal").isin(list(signals)) & F.col("transform").isin(list(transforms)))
    if kinds:
        chosen = chosen | F.col("transform").isin(kinds)
    causal = F.assert_true(F.col("causal"), F.lit("registry holds non-causal entries")).isNull()
    return reg.filter(causal).filter(chosen).dropDuplicates(["feature_name"])


def selected_names(selection: DataFrame, signals: Sequence[str]) -> list[str]:
    """Names for a ``select``; the registry is metadata of a few hundred rows at most."""
    rows = selection.select("feature_name", "base_signal").collect()
    unused = set(signals) - {r.base_signal for r in rows}
    if unused:
        raise ValueError(f"signals without features: {sorted(unused)}")
    return sorted(r.feature_name for r in rows)


def available_features(reg: DataFrame) -> DataFrame:
    """Features that can exist at prediction time."""
    return reg.filter(~F.col("diagnostic"))
