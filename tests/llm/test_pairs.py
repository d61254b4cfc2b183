import re
from collections import Counter

import numpy as np
import pytest

from tidegrid.llm import components, op2_near_vectors, op3_collision_search, op7_jaccard
from tidegrid.llm.common import table
from pyspark.sql import functions as F

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def smallest(n, links):
    label = list(range(n))
    def root(x):
        while label[x] != x:
            x = label[x]
        return x
    for a, b in links:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def test_components_of_paths_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 260)] + [(7, 7), (8, 9), (9, 8), (260, 160)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = smallest(300, links)
    assert got == {v: want[v] for e in links if e[0] != e[1] for v in e}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def vectors_of(rows):
    return {k: np.asarray(v, float) for k, v in rows}


def test_op2_equals_brute_force_on_clusters(spark):
    random = np.random.default_rng(4)
    centres = random.normal(size=(12, 32))
    x = np.vstack([c + random.normal(size=(n, 32)) * s for c, n, s in zip(centres, (1, 2, 90, 5, 40, 3, 1, 1, 8, 20, 2, 2), [0.12, 0.3] * 6)] + [centres[:3], centres[:3] * 2])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    want = smallest(len(x), np.argwhere(near).tolist())
    got = {r.vec_id: r for r in op2_near_vectors.near_vectors(df, window=8).collect()}
    assert [got[i].component_id for i in range(len(x))] == want
    assert [got[i].n_links for i in range(len(x))] == near.sum(1).tolist()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


@pytest.mark.parametrize("mean", [0.8, 0.9])
def test_op2_dense_cluster_of_a_third_of_all_rows(spark, mean):
    random = np.random.default_rng(7)
    normed = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    noise = normed(random.normal(size=(2000, 64)))
    dense = np.sqrt(mean) * normed(random.normal(size=(1, 64))) + np.sqrt(1 - mean) * noise
    u = normed(np.vstack([random.normal(size=(4000, 64)), dense]))
    u = normed(np.vstack([u, u[3500:4500] + normed(random.normal(size=(1000, 64))) * 0.285]))
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(u)], "vec_id bigint, embedding array<double>")
    got = {r.vec_id: r for r in op2_near_vectors.near_vectors(df).collect()}
    crowd = np.r_[4000:6000, 6500:7000]
    want = smallest(len(u), np.argwhere(near).tolist())
    assert near[crowd].sum() >= 900
    assert np.mean([got[i].n_links == near[i].sum() and got[i].component_id == want[i] for i in crowd]) >= 0.999
    assert np.mean([got[i].n_links == near[i].sum() for i in range(len(u))]) >= 0.995


def test_op2_window_bridges_short_partitions(spark, monkeypatch):
    monkeypatch.setattr(op2_near_vectors, "ROWS", 6)
    u = np.random.default_rng(9).normal(size=(60, 3))
    u /= np.linalg.norm(u, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tobytes()) for i, v in enumerate(u)], "id bigint, vector binary")
    edges = op2_near_vectors.near_edges(df, 1, 60, 0.95, 64, 62)[0].collect()
    assert smallest(60, [(e.a, e.b) for e in edges]) == smallest(60, np.argwhere(u @ u.T >= 0.95).tolist())


def test_op2_odd_rows(spark, odd_vectors):
    rows = sorted((r.vec_id or -1, r.n_links, r.component_id) for r in op2_near_vectors.near_vectors(odd_vectors).collect())
    assert rows == sorted([(-1, 0, None), *((i, 0, i) for i in (1, 2, 3, 4, 5, 6, 10, 40, 60)), (7, 4, 7), (8, 4, 7), (9, 4, 7), (9, 4, 7), (20, 4, 7)])
    assert op2_near_vectors.near_vectors(odd_vectors.limit(0)).count() == 0


def test_op3_recall_order_and_ties(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    asked = table(spark, sf, "embeddings")
    got = {}
    for r in op3_collision_search.search(asked, F.col("vec_id") % 20 == 0, least=100).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    for q, found in got.items():
        score = x @ x[ids == q][0]
        score[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -score))[:20]]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert [f[2] for f in found] == pytest.approx([score[ids == f[1]][0] for f in found], abs=1e-12)
        hits += len(set(best) & {f[1] for f in found})
    assert len(got) == (ids % 20 == 0).sum() and hits >= 0.9 * 20 * len(got)


def test_op3_odd_rows(odd_vectors):
    rows = [(r.query_id, r.rank, r.vec_id) for r in op3_collision_search.search(odd_vectors, F.col("vec_id") % 20 == 0).collect()]
    assert sorted(r for r in rows if r[0] == 20) == [(20, 1, 8), (20, 2, 7), (20, 3, 9), (20, 4, 9), (20, 5, 40)]
    assert {r[0] for r in rows} == {20, 40}
    assert op3_collision_search.search(odd_vectors.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def shingles(text):
    w = WORD.findall((text or "").encode().translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    links = [(i, j) for i in range(len(docs)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    groups = {}
    for i, r in enumerate(smallest(len(docs), links)):
        groups.setdefault(r, []).append(i)
    least = {i: min((docs[k][0] for k in g if docs[k][0] is not None), default=None) for g in groups.values() for i in g}
    return Counter((docs[i][0], len(sets[i]), least[i]) for i in range(len(docs)))


def variants():
    """Near copies of short and long texts, on both sides of the similarity and of the light-heavy boundary."""
    random = np.random.default_rng(8)
    out = []
    for size in (4, 5, 8, 12, 20, 30, 45, 80, 160, 400):
        base = [f"t{size}w{random.integers(10**6)}" for _ in range(size)]
        for edits in (0, 0, 1, 1, 2, 3, 5, 9, 14):
            words = list(base)
            for i in random.integers(0, size, min(edits, size)):
                words[i] = f"e{random.integers(10**6)}"
            out.append(" ".join(words))
            out.append(" ".join(words[: max(1, size - edits)]))
    passage = " ".join(f"p{i}" for i in range(60))
    return out + [passage + " " + " ".join(f"q{k}_{i}" for i in range(100)) for k in range(30)]


def test_op7_equals_brute_force(spark, sf, odd_docs, no_docs):
    made = spark.createDataFrame(list(enumerate(variants())), "doc_id bigint, text string")
    for docs in (table(spark, sf, "documents"), made, odd_docs):
        want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in op7_jaccard.join_near(docs).collect()) == want
    assert op7_jaccard.join_near(no_docs).count() == 0


def test_op7_keeps_one_of_each_group(odd_docs, no_docs):
    kept = op7_jaccard.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id or -1, (r.text or "")[:6]) for r in kept.collect()) == sorted(
        [(1, ""), (2, ""), (3, " \n\t "), (4, "very l"), (5, "w0 w1 "), (-1, ""), (8, "one tw"), (10, "xxxxxx"), (11, "é ß ñ "), (-1, "alone ")])
    assert op7_jaccard.keep_one(no_docs).count() == 0


def test_op7_boundary_and_bound():
    assert op7_jaccard.boundary([], 0.0) == 0
    sizes = [(n, 10) for n in range(2, 400)]
    assert 7 <= op7_jaccard.boundary(sizes, 2.0) <= op7_jaccard.boundary(sizes, 8.0) < 200
    random = np.random.default_rng(1)
    for n, m in ((3, 4), (50, 60), (1000, 3000)):
        a, b = (np.unique(random.integers(0, 2 * m, k).astype(np.uint64)) for k in (n, m))
        assert op7_jaccard.overlap_bound(op7_jaccard.cells(a), op7_jaccard.cells(b)) >= len(np.intersect1d(a, b))


def test_op7_copies_around_the_limit_meet_few_others(spark, monkeypatch):
    random = np.random.default_rng(3)
    base, texts = [f"w{i}" for i in range(150)], []
    for i in range(400):
        words = list(base)
        for k in random.choice(150, 1 + i % 3 if i % 50 else 6, replace=False):
            words[k] = f"x{random.integers(1 << 30)}"
        texts.append(" ".join(words))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    want = smallest(len(sets), [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    met, verify = [], op7_jaccard.verify

    def counted(pairs, *rest):
        met.append(pairs.count())
        return verify(pairs, *rest)

    monkeypatch.setattr(op7_jaccard, "verify", counted)
    monkeypatch.setattr(op7_jaccard, "REACH", 16, raising=False)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in op7_jaccard.join_near(df).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert len(set(want)) > 1
    assert sum(met) < 40 * len(texts), met  # 100 a text when each met all others at once
