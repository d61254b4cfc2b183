from fractions import Fraction

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import episodes, neighbors, ordering


@pytest.fixture
def skewed(spark):
    """One group holds most rows; values have ties, extremes and both signs."""
    rng = np.random.default_rng(11)
    hot = np.concatenate([rng.normal(1000, 0.5, 3000), [-999.0, 1.8e30, -7.25], np.repeat(1000.0, 500)])
    cold = rng.normal(-3, 40, 200)
    pdf = pd.DataFrame({"g": ["hot"] * len(hot) + ["cold"] * 200 + ["one"], "v": [*hot, *cold, 4.0]})
    pdf["y"] = rng.random(len(pdf)) < 0.3
    pdf["w"] = rng.uniform(0.1, 3, len(pdf)).round(3)
    pdf["u"] = (pdf.v.clip(-50, 1002) + rng.normal(0, 1, len(pdf))).round(1)
    return pdf, spark.createDataFrame(pdf)


def test_quantiles_equal_numpy(skewed):
    pdf, df = skewed
    probs = [0.0, 0.005, 0.25, 0.5, 0.75, 0.995, 1.0]
    got = {(r.g, r.prob): r.quantile for r in ordering.quantiles(df, ["g"], "v", probs).collect()}
    for g, part in pdf.groupby("g"):
        for p in probs:
            assert got[(g, p)] == pytest.approx(np.quantile(part.v, p), rel=1e-12), (g, p)


def test_interpolation_equals_a_fused_multiply_add(spark):
    """Quantiles are limits that rows are compared with, so they equal the SQL's to the last bit."""
    rng = np.random.default_rng(3)
    low, share = rng.uniform(-300, 300, 20_000).round(2), rng.random(20_000)
    high = low + rng.uniform(0, 40, 20_000).round(2)
    df = spark.createDataFrame(pd.DataFrame({"low": low, "high": high, "share": share}))
    out = df.withColumn("q", ordering.interpolated(F.col("low"), F.col("high"), F.col("share"))).toPandas()
    want = [float(Fraction(a) * Fraction(1 - s) + Fraction(b * s)) for a, b, s in zip(out.low, out.high, out.share)]
    assert list(out.q) == want
    huge = df.limit(1).select(ordering.interpolated(F.lit(-1.5e308), F.lit(1.5e308), F.lit(0.25)))
    assert huge.first()[0] == pytest.approx(-0.75e308)


def test_quantiles_equal_duckdb_to_the_last_bit(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"g": rng.integers(0, 60, 3000), "v": rng.uniform(0, 300, 3000).round(2)})
    pdf = pd.concat([pdf, pd.DataFrame({"g": 60, "v": [193.18] * 10})], ignore_index=True)   # its 5 % is 193.17999999999998
    probs = [0.05, 0.2, 0.25, 0.5, 0.8, 0.95]
    got = {(r.g, r.prob): r.quantile for r in ordering.quantiles(spark.createDataFrame(pdf), ["g"], "v", probs).collect()}
    want = duckdb.sql("SELECT g, " + ", ".join(f"quantile_cont(v, {p})" for p in probs) + " FROM pdf GROUP BY 1").fetchall()
    assert got == {(row[0], p): q for row in want for p, q in zip(probs, row[1:])}


def test_prefix_sums(skewed):
    pdf, df = skewed
    out = ordering.prefix_sums(df.withColumn("n", F.lit(1)), ["g"], "v", ["n"]).toPandas()
    for g, part in out.groupby("g"):
        want = pdf[pdf.g == g].v.value_counts().sort_index()
        part = part.sort_values("v")
        assert list(part.n) == list(want) and list(part.n_below) == list(want.cumsum() - want)


def test_rank_statistics(skewed):
    pdf, df = skewed
    auc = {r.g: r.auc for r in ordering.rank_auc(df, ["g"], "v", "y", "auc").collect()}
    rho = {r.g: r.rho for r in ordering.spearman(df, ["g"], "v", "u", "rho").collect()}
    ap = {r.g: r.ap for r in ordering.average_precision(df, ["g"], "v", "y", "ap").collect()}
    med = {r.g: r.m for r in ordering.weighted_median(df, ["g"], "v", "w", "m").collect()}
    for g in ("hot", "cold"):
        part = pdf[pdf.g == g]
        r, pos, neg = part.v.rank(), part.y.sum(), (~part.y).sum()
        assert auc[g] == pytest.approx((r[part.y].sum() - pos * (pos + 1) / 2) / (pos * neg))
        assert rho[g] == pytest.approx(part.v.rank().corr(part.u.rank()))
        by = part.groupby("v").y.agg(["sum", "count"]).sort_index(ascending=False)
        assert ap[g] == pytest.approx((by["sum"] / pos * by["sum"].cumsum() / by["count"].cumsum()).sum())
        o = part.sort_values("v")
        assert med[g] == o.v.iloc[np.searchsorted(o.w.cumsum().to_numpy(), o.w.sum() / 2 - 1e-9)]
    assert rho["one"] is None and auc["one"] is None


def test_leave_one_out_equals_removal(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"g": rng.integers(0, 6, 60), "v": rng.integers(0, 12, 60).astype(float), "y": rng.random(60) < 0.5})
    got = {r.g: r.acc for r in episodes.leave_one_out_accuracy(spark.createDataFrame(pdf), ["g"], "v", "y", "acc").collect()}
    for g, part in pdf.groupby("g"):
        said = []
        for i in part.index:
            rest = part.drop(i)
            a, b = rest[rest.y].v.median(), rest[~rest.y].v.median()
            if pd.isna(a) or pd.isna(b):
                continue
            v, cut = part.v[i], (a + b) / 2
            said.append((part.y[i], v >= cut if a >= b else v <= cut))
        rates = [np.mean([s == y for y, s in said if y == k]) for k in (True, False) if any(y == k for y, _ in said)]
        assert got.get(g) == (pytest.approx(np.mean(rates)) if rates else None)


def test_diverse_neighbors_hand_case(frame):
    df = frame([(0, i, d, x) for i, (d, x) in enumerate(zip("aaabc", (.1, .2, .3, .4, .5)))], "q int, item int, day string, d double")
    out = neighbors.diverse_top_k(df, ["q"], "item", "day", "d", 3, 1)
    assert [r.item for r in out.orderBy("neighbor_rank").collect()] == [0, 3, 4]


@pytest.mark.parametrize("pivots,block", [(1, 2048), (7, 10)])
def test_neighbors_equal_brute_force(spark, pivots, block):
    rng = np.random.default_rng(9)
    # One tight cluster holds most of the library: its cell is cut into many blocks.
    pts = np.concatenate([rng.normal(0, 0.05, (120, 3)), rng.normal(3, 1.0, (60, 3))])
    lib = spark.createDataFrame([(("s", "t")[i % 5 == 0], i, int(i % 9), [float(x) for x in p]) for i, p in enumerate(pts)],
                                "k string, item int, day int, v array<double>")
    out = neighbors.nearest_neighbors(lib, lib, ["k"], query="item", item="item", vector="v", day="day", k=4, per_day=1,
                                      skip_self=True, pivots=pivots, block_rows=block, batch_rows=25).toPandas()
    got = {q: list(g.sort_values("neighbor_rank").item_id) for q, g in out.groupby("query_id")}
    for i, p in enumerate(pts):
        same = [j for j in range(len(pts)) if (j % 5 == 0) == (i % 5 == 0) and j != i]
        order = sorted(same, key=lambda j: (np.sqrt(np.mean((pts[j] - p) ** 2)), j))
        want, days = [], set()
        for j in order:
            if j % 9 not in days:
                want.append(j)
                days.add(j % 9)
            if len(want) == 4:
                break
        assert got[i] == want


def test_neighbor_blend_hand_case(frame):
    near = frame([("k", 0, 0, "a", 1.0), ("k", 0, 1, "b", 1.0)], "k string, query_id int, item_id int, day string, distance double")
    future = frame([("k", 0, 15, 10.0), ("k", 0, 30, 20.0), ("k", 1, 15, 30.0), ("k", 1, 30, 40.0)],
                   "k string, item_id int, horizon_minutes int, value double")
    got = {r.horizon_minutes: r.prediction for r in neighbors.blend_neighbors(near, future, ["k"], 1e-6).collect()}
    assert got == {15: 20.0, 30: 30.0}
    assert neighbors.neighbor_diagnostics(near, ["k"], 1e-6).first().effective_neighbor_count == pytest.approx(2.0)


def test_neighbors_without_a_key_search_several_cells(spark):
    rng = np.random.default_rng(3)
    pts = rng.normal(0, 1, (80, 4))
    df = spark.createDataFrame([(i, i % 7, [float(x) for x in p]) for i, p in enumerate(pts)], "item int, day int, v array<double>")
    out = neighbors.nearest_neighbors(df, df, [], query="item", item="item", vector="v", day="day", k=3, per_day=3, skip_self=True, pivots=6)
    got = {q: list(g.sort_values("neighbor_rank").item_id) for q, g in out.toPandas().groupby("query_id")}
    for i, p in enumerate(pts):
        d = np.sqrt(np.mean((pts - p) ** 2, axis=1))
        assert got[i] == [j for j in np.argsort(d, kind="stable") if j != i][:3]


def test_null_keys_nan_and_infinity(frame):
    """NULL is a group of its own; NaN is the largest score; infinities order as usual."""
    scores = [0.1, 0.4, float("nan"), float("inf"), float("-inf"), 1e17, 0.4]
    rows = [(k, v, i % 2 == 0) for k in ("a", None) for i, v in enumerate(scores)]
    df = frame(rows, "k string, v double, y boolean")
    got = {r.k: r.quantile for r in ordering.quantiles(df, ["k"], "v", [0.5]).collect()}
    assert got == {"a": pytest.approx(0.4), None: pytest.approx(0.4)}
    ends = {(r.k, r.prob): r.quantile for r in ordering.quantiles(df, ["k"], "v", [0.0, 1.0]).collect()}
    assert ends[None, 0.0] == float("-inf") and ends[None, 1.0] == float("inf")
    ranks = pd.Series(scores).fillna(np.inf).rank()
    ranks[2], ranks[3] = 7, 6  # NaN after infinity
    y = np.arange(7) % 2 == 0
    want = (ranks[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    assert {r.k: r.auc for r in ordering.rank_auc(df, ["k"], "v", "y", "auc").collect()} == {"a": pytest.approx(want), None: pytest.approx(want)}


def test_adjacent_keeps_null_keys(frame):
    from tidegrid.operators import chunks
    rows = [(None, "2025-01-01 00:00:00"), (None, "2025-01-02 00:00:00"), ("a", "2025-01-01 00:00:00")]
    out = chunks.adjacent(frame(rows, "k string, ts timestamp_ntz"), ["k"], "ts", "before").collect()
    assert len(out) == 3 and sum(r.before is not None for r in out) == 1


def test_an_empty_library_gives_no_neighbours(spark):
    df = spark.createDataFrame([("a", 1, [1.0, 2.0], "d")], "k string, item int, v array<double>, day string")
    out = neighbors.nearest_neighbors(df, df.limit(0), ["k"], query="item", item="item", vector="v", day="day", k=2, per_day=1)
    assert out.columns == ["k", "query_id", "item_id", "day", "distance", "neighbor_rank"] and out.count() == 0


def test_large_blocks_equal_brute_force(monkeypatch):
    """Matrix products leave the right pairs: copies, far values that cost precision, with and without a limit."""
    monkeypatch.setattr(neighbors, "CELLS", 40_000)
    rng = np.random.default_rng(12)
    matrix = np.concatenate([rng.normal(size=(1500, 8)), np.repeat(rng.normal(size=(1, 8)), 300, 0), rng.normal(1e7, 1, (200, 8))])
    ids, days = np.arange(len(matrix)) * 3, rng.integers(0, 5, len(matrix))
    asked, names = matrix[::40], ids[::40]
    dist = np.sqrt(np.mean(np.square(matrix[None] - asked[:, None]), axis=2))
    want = [neighbors._pick(row, ids, days, name, 6, 2) for row, name in zip(dist, names)]
    for limit in (np.full(len(asked), np.inf), np.array([row[w[-1]] for row, w in zip(dist, want)])):
        found = neighbors._search_block(matrix, ids, days, asked, names, limit.copy(), 6, 2)
        q, i, d = (np.concatenate([f[c] for f in found]) for c in range(3))
        assert (d == dist[q, i]).all() and len(q) < 40 * len(asked)
        for n in range(len(asked)):
            mine = np.sort(i[q == n])
            picked = neighbors._pick(dist[n, mine], ids[mine], days[mine], names[n], 6, 2)
            assert list(mine[picked]) == want[n]


def test_many_small_keys_are_not_cut_into_cells(spark, monkeypatch):
    """Cells follow the largest key's rows, so a small library is searched whole; groups share tasks."""
    monkeypatch.setattr(neighbors, "CELL_ROWS", 30)
    asked = []
    monkeypatch.setattr(neighbors, "pick_pivots", lambda *a, pick=neighbors.pick_pivots: asked.append(a[3]) or pick(*a))
    rng = np.random.default_rng(13)
    pdf = pd.DataFrame({"k": np.repeat(np.arange(60), 25), "item": np.arange(1500), "day": rng.integers(0, 9, 1500), "v": list(rng.normal(size=(1500, 3)))})
    lib = spark.createDataFrame(pdf)
    out = neighbors.nearest_neighbors(lib, lib, ["k"], query="item", item="item", vector="v", day="day", k=3, per_day=1, skip_self=True).toPandas()
    assert asked == [1] and len(out) == 4500
    for k, part in pdf.groupby("k"):
        points = np.stack(part.v)
        for item, point in zip(part.item.iloc[:3], points):
            d = np.sqrt(np.mean((points - point) ** 2, axis=1))
            want = part.item.to_numpy()[neighbors._pick(d, part.item.to_numpy(), part.day.to_numpy(), item, 3, 1)]
            assert list(out[out.query_id == item].sort_values("neighbor_rank").item_id) == list(want)
