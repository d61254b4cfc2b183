import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import logistic


def plain(x, y, ridge, w=None):
    """Newton on one group, to the limit of doubles."""
    w = np.ones(len(y)) if w is None else w
    x = np.array(x, float)
    med = np.nanmedian(x, 0)
    x = np.where(np.isnan(x), med, x)
    mean, dev = x.mean(0), x.std(0)
    z = np.column_stack([np.ones(len(y)), (x - mean) / np.where(dev > 1e-12, dev, 1)])
    b, shrink = np.zeros(z.shape[1]), np.r_[0, np.full(x.shape[1], ridge)]
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ b))
        g = z.T @ (w * (p - y)) / w.sum() + shrink * b
        b -= np.linalg.solve(z.T @ (z * (w * p * (1 - p))[:, None]) / w.sum() + np.diag(shrink), g)
    return b, 1 / (1 + np.exp(-z @ b))


@pytest.fixture(scope="module")
def rows():
    dice = np.random.default_rng(6)
    out = []
    for g, n in (("a", 400), (None, 150), ("b", 3000)):
        x = dice.normal(size=(n, 3)) * [1, 1e3, 1e-4] + [0, 1e6, 5]
        y = dice.random(n) < 1 / (1 + np.exp(-(x[:, 0] * 2 + (x[:, 1] - 1e6) / 1e3 - 1)))
        x[dice.random((n, 3)) < 0.05] = np.nan
        out += [(g, *(None if np.isnan(v) else float(v) for v in r), int(c), float(k)) for r, c, k in zip(x, y, dice.uniform(0.5, 2, n))]
    return out


@pytest.mark.parametrize("weight", [None, "w"])
def test_all_groups_equal_their_own_newton(spark, rows, weight):
    df = spark.createDataFrame(rows, "g string, x0 double, x1 double, x2 double, y int, w double")
    xs = ["x0", "x1", "x2"]
    model = logistic.fit_logistic(df, ["g"], xs, "y", weight)
    got = {r.g: r for r in model.collect()}
    scored = logistic.logistic_probability(df.withColumn("n", F.monotonically_increasing_id()), model, ["g"], xs)
    for g in ("a", None, "b"):
        mine = [r for r in rows if r[0] == g]
        x = np.array([[np.nan if v is None else v for v in r[1:4]] for r in mine])
        b, p = plain(x, np.array([r[4] for r in mine]), logistic.RIDGE, np.array([r[5] for r in mine]) if weight else None)
        assert [got[g][f"scaled_{x}"] for x in xs] == pytest.approx(b[1:], rel=1e-7)
        assert got[g].gradient <= logistic.TOLERANCE and got[g].fit_rows == len(mine)
        own = scored.where(F.col("g").eqNullSafe(F.lit(g))).orderBy("n").toPandas()["probability"]
        assert sorted(own) == pytest.approx(sorted(p), rel=1e-7)


def test_one_class_separable_and_constant_inputs(spark):
    df = spark.createDataFrame([("one", float(i), 1.0, 1) for i in range(9)] + [("split", float(i), 1.0, int(i > 4)) for i in range(9)] + [("empty", None, None, i % 2) for i in range(6)], "g string, x double, c double, y int")
    got = {r.g: r for r in logistic.fit_logistic(df, ["g"], ["x", "c"], "y").collect()}
    assert got["one"].intercept is None and got["one"].fit_rows == 9
    assert got["split"].gradient <= logistic.TOLERANCE and got["split"].scaled_x > 1 and got["split"].scaled_c == pytest.approx(0, abs=1e-9)
    assert got["empty"].scaled_x == 0 and got["empty"].intercept == pytest.approx(0, abs=1e-9)
    scored = logistic.logistic_probability(df, spark.createDataFrame(list(got.values()), "g string, fit_rows bigint, positives bigint, intercept double, beta_x double, scaled_x double, median_x double, beta_c double, scaled_c double, median_c double, gradient double, rounds int"), ["g"], ["x", "c"])
    assert scored.where("g = 'one' AND probability IS NULL").count() == 9 and scored.where("g <> 'one' AND probability IS NULL").count() == 0


def test_no_rows(spark):
    assert logistic.fit_logistic(spark.createDataFrame([], "g string, x double, y int"), ["g"], ["x"], "y").count() == 0


def test_out_of_fold_rows_never_see_their_own_fold(spark):
    dice = np.random.default_rng(1)
    rows = [(f, float(v), int(dice.random() < 0.5)) for f in range(3) for v in dice.normal(size=80)]
    df = spark.createDataFrame(rows, "fold int, x double, y int")
    got = logistic.out_of_fold(df, "fold", range(3), ["x"], "y").toPandas()
    for f in range(3):
        others = [r for r in rows if r[0] != f]
        b, _ = plain(np.array([[r[1]] for r in others]), np.array([r[2] for r in others]), logistic.RIDGE)
        x = np.array([r[1] for r in others])
        own = got[got.fold == f]
        assert own.probability.to_numpy() == pytest.approx(1 / (1 + np.exp(-(b[0] + b[1] * (own.x - x.mean()) / x.std()))), rel=1e-7)


def test_earlier_folds_are_strictly_earlier(spark):
    df = spark.createDataFrame([(f,) for f in ("f1", "f2", "f3")], "fold string")
    assert sorted(map(tuple, logistic.earlier_folds(df, "fold", ["f1", "f2", "f3"], "to").collect())) == [("f1", "f2"), ("f1", "f3"), ("f2", "f3")]
