"""Contract checks that return rows: an empty table means the contract holds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegrid.functions.timeline import epoch_minutes
from tidegrid.operators.compare import same_rows
from tidegrid.operators.grid import duplicate_keys
from tidegrid.operators.profile import time_steps
from tidegrid.operators.sizing import join_keys

MESSAGES = "table_name string, severity string, problem string, detail bigint"


def _count(name: str, severity: str, problem: str, df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("detail")).select(
        F.lit(name).alias("table_name"), F.lit(severity).alias("severity"), F.lit(problem).alias("problem"), "detail")


def raw_contract(spark: SparkSession, tables: Mapping[str, DataFrame], columns: Mapping[str, Sequence[str]],
                 keys: Sequence[str], ts: str, step: int) -> DataFrame:
    """Columns and order (from the schema), duplicate keys, off-step moments, families on the same moments."""
    facts = []
    parts = []
    names = list(tables)
    for name in names:
        df, want = tables[name], list(columns[name])
        missing = [c for c in want if c not in df.columns]
        facts.append((name, "error", "missing_columns", len(missing)))
        facts.append((name, "warning", "extra_columns", len([c for c in df.columns if c not in want])))
        facts.append((name, "error", "column_order", int([c for c in df.columns if c in want]
                                                         != [c for c in want if c in df.columns])))
        parts.append(_count(name, "error", "duplicate_keys", duplicate_keys(df, [*keys, ts])))
        parts.append(_count(name, "warning", "off_step_moments",
                            time_steps(df, keys, ts).filter(F.col("step_minutes") != step)))
    base = tables[names[0]].select(*keys, ts).distinct()
    for name in names[1:]:
        parts.append(_count(name, "error", "moments_not_in_first_table",
                            join_keys(tables[name].select(*keys, ts).distinct(), base, [*keys, ts], "left_anti")))
    out = spark.createDataFrame(facts, MESSAGES)
    for p in parts:
        out = out.unionByName(p)
    return out.filter("detail > 0")


def result_contract(df: DataFrame, expected_keys: DataFrame, keys: Sequence[str], part: str, total: str, *,
                    part_max: float, total_max: float) -> DataFrame:
    """Key coverage, missing or non-finite values, physical bounds, part within total; one row per problem."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    p, t = F.col(part), F.col(total)
    tests = {"not_finite": bad(part) | bad(total), "negative": (p < 0) | (t < 0),
             "above_maximum": (p > part_max) | (t > total_max), "part_above_total": p > t}
    row = df.agg(F.array(*[F.struct(F.lit(n).alias("problem"), F.count_if(c).alias("detail")) for n, c in tests.items()])
                 .alias("_a")).select(F.inline("_a"))
    count = lambda name, d: d.agg(F.count(F.lit(1)).alias("detail")).select(F.lit(name).alias("problem"), "detail")
    have = df.select(*keys)
    return (row.unionByName(count("missing_keys", join_keys(expected_keys.select(*keys), have, list(keys), "left_anti")))
            .unionByName(count("unexpected_keys", join_keys(have, expected_keys.select(*keys), list(keys), "left_anti")))
            .unionByName(count("duplicate_keys", duplicate_keys(df, keys))))


def registry_problems(registry: DataFrame) -> DataFrame:
    """Features reading the future, flagged non-causal, diagnostic, or named twice."""
    flags = F.array(F.when(F.col("source_offset_max_minutes") > 0, F.lit("reads_future")),
                    F.when(~F.col("causal"), F.lit("not_causal")), F.when(F.col("diagnostic"), F.lit("diagnostic")))
    single = registry.select("feature_name", F.explode(F.filter(flags, lambda f: f.isNotNull())).alias("problem"))
    twice = registry.groupBy("feature_name").count().filter("count > 1").select(
        "feature_name", F.lit("duplicate_name").alias("problem"))
    return single.unionByName(twice)


def future_change(operator, df: DataFrame, ts: str, cut, columns: Sequence[str], shift: float = 1000.0) -> DataFrame:
    """Rows at or before ``cut`` whose features move when only later inputs are changed: must be empty."""
    later = F.col(ts) > cut
    changed = df.withColumns({c: F.when(later, F.coalesce(F.col(c), F.lit(0.0)) + shift).otherwise(F.col(c))
                              for c in columns})
    keep = F.col(ts) <= cut
    return same_rows(operator(df).filter(keep), operator(changed).filter(keep))


def cell_count(df: DataFrame, factors: Sequence[str]) -> DataFrame:
    """Rows against the product of the distinct levels of each factor."""
    rows = df.agg(F.count(F.lit(1)).alias("row_count"), *[F.count_distinct(c).alias(f"{c}_levels") for c in factors])
    product = F.lit(1)
    for c in factors:
        product = product * F.col(f"{c}_levels")
    return rows.withColumn("expected_rows", product).withColumn("complete", F.col("row_count") == F.col("expected_rows"))


def off_grid(df: DataFrame, ts: str, step: int) -> DataFrame:
    return df.filter(epoch_minutes(ts) % step != 0)
