"""Registered queries: one output spec drives the Spark result and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, "Query"] = {}
# Means of cents often end exactly half-way between two sixth decimals, where engines round
# differently; both sides are moved off that point by the same invisible amount.
NUDGE = 1.2345e-08


@dataclass(frozen=True)
class Query:
    name: str
    columns: tuple[tuple[str, str], ...]
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return finish(self.run(spark, sf_dir), self.columns)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        picks = ", ".join(_sql_cell(c, k) for c, k in self.columns)
        return f"SELECT {picks} FROM (\n{self.sql}\n) AS result"


def parse_spec(spec: str) -> tuple[tuple[str, str], ...]:
    """``name:kind`` items; kinds: s text, i integer, b flag, d double, t moment, D day."""
    return tuple(tuple(item.strip().rsplit(":", 1)) for item in spec.split(","))


def finish(df: DataFrame, columns) -> DataFrame:
    """Stable output types: doubles to six decimals, moments and days as text, flags as integers."""
    cells = []
    for name, kind in columns:
        c = F.col(f"`{name}`")
        if kind == "d":
            c = F.round(c.cast("double") + F.lit(NUDGE), 6) + F.lit(0.0)
        elif kind in ("i", "b"):
            c = c.cast("int").cast("bigint") if kind == "b" else c.cast("bigint")
        elif kind == "t":
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind == "D":
            c = F.date_format(c, "yyyy-MM-dd")
        else:
            c = c.cast("string")
        cells.append(c.alias(name))
    return df.select(*cells)


def _sql_cell(name: str, kind: str) -> str:
    q = f'"{name}"'
    body = {"d": f"round(CAST({q} AS DOUBLE) + {NUDGE}, 6) + 0.0", "i": f"CAST({q} AS BIGINT)",
            "b": f"CAST(CAST({q} AS INTEGER) AS BIGINT)", "t": f"strftime(CAST({q} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')",
            "D": f"strftime(CAST({q} AS DATE), '%Y-%m-%d')", "s": f"CAST({q} AS VARCHAR)"}[kind]
    return f"{body} AS {q}"


def query(name: str, spec: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(name, parse_spec(spec), fn, sql)
        return fn
    return register
