"""MLlib tree estimators as backtest jobs over fold-keyed training tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, functions as F


def _assembled(xs: Sequence[str]) -> list:
    filled = [f"{x}__filled" for x in xs]
    return [Imputer(inputCols=list(xs), outputCols=filled, strategy="median"),
            VectorAssembler(inputCols=filled, outputCol="_features", handleInvalid="skip")]


def tree_model(train: DataFrame, xs: Sequence[str], y: str, weight: str | None = None, *, rounds: int = 10,
               depth: int = 3, seed: int = 7):
    """Median imputation and a boosted absolute-error tree ensemble, trained by all executors.

    An input without any value in the training rows has no median and teaches nothing: it is left out.
    """
    held = train.agg(*[F.count(x).alias(x) for x in xs]).first()
    xs = [x for x in xs if held[x]]
    tree = GBTRegressor(featuresCol="_features", labelCol=y, predictionCol="prediction", lossType="absolute",
                        maxIter=rounds, maxDepth=depth, stepSize=0.2, seed=seed)
    if weight:
        tree = tree.setWeightCol(weight)
    return Pipeline(stages=[*_assembled(xs), tree]).fit(train)


def score(model, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    return model.transform(rows).select(*keep, F.greatest(F.lit(0.0), F.col("prediction")).alias("prediction"))


def per_group(groups: Sequence, job: Callable, threads: int = 4) -> list:
    """Run one distributed fit per group from a small driver thread pool, so that their stages overlap."""
    with ThreadPoolExecutor(max_workers=min(threads, max(1, len(groups)))) as pool:
        return list(pool.map(job, groups))


def importances(model, xs: Sequence[str], spark) -> DataFrame:
    used = dict(zip(model.stages[0].getInputCols(), model.stages[-1].featureImportances.toArray()))
    values = [used.get(x, 0.0) for x in xs]
    return spark.createDataFrame([(x, float(v)) for x, v in zip(xs, values)], "feature string, importance double")
