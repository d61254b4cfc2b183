"""All registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegrid.plans import backtest, blends, contracts, joins, live, logistic, models, scans, scores, windows  # noqa: F401
from tidegrid.plans.registry import QUERIES

__all__ = ["QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["e17_naive_forecasts_scored"].frame(spark, sf_dir)
