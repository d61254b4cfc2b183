"""Conversation trie, token counts and hard negatives against brute force."""

import hashlib
import math
import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest

from tidegrid.llm import op11_prefix_trie as trie, op12_token_counts as counts, op13_hard_negatives as hard

TALK = "conv_id bigint, turn bigint, role string, text string, c int, depth string, part int"


def plain_trie(rows):
    own, members, ends, below = defaultdict(list), defaultdict(list), defaultdict(list), defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = role or "", text or ""
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}:{text}".encode()).hexdigest(), (role, text)))
    own = {c: [t[-1] for t in sorted(turns)] for c, turns in own.items()}
    for c in sorted(own):
        h = crc32(str(c).encode()) % 6
        turns = own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    for p in members:
        if p:
            below[p[:-1]].append(p)
    totals, out = {}, {}
    for p in sorted(members, key=len, reverse=True):
        n = len(members[p])
        totals[p] = ((n - 1) * len(p[-1][1]) if p else 0) + sum(totals[k][0] for k in below[p]), (not below[p]) + sum(totals[k][1] for k in below[p])
        ended = hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()
        out[members[p][0], len(p)] = (members[p[:-1]][0] if p else None, n, len(below[p]), totals[p][1], totals[p][0], ended)
    return out


def test_trie_of_chains_bushes_copies_and_odd_rows(spark):
    dice = random.Random(5)
    rows = [(c, t, "user", f"{dice.randrange(2)}") for c in range(200, 330) for t in range(dice.randrange(7))]
    rows += [(c, t, "user", f"long {t}") for c in (400, 401) for t in range(70)] + [(c, t, "a", "same") for c in range(500, 560) for t in range(9)]
    rows += [(-205, t, "user", "below zero") for t in range(8)] + [(7, None, None, None), (7, 1, "x", None), (7, 1, None, "x"), (7, 1, None, "x"), (None, 1, "user", "nobody"), (901, 0, "u", "one"), (8, 3, "", "é漢😀" * 3000)]
    df = spark.createDataFrame([(*r, 1, "d", 2) for r in rows], TALK)
    got = {(r.conv_id, r.depth): tuple(r)[2:] for r in trie.prefix_trie(df).collect()}
    assert got == plain_trie(rows)
    assert any(d == 70 for _, d in got)


def test_trie_of_no_conversations(spark):
    assert trie.prefix_trie(spark.createDataFrame([], TALK)).count() == 0
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "u", "t", 1, "d", 2)], TALK)).count() == 0


def test_contraction_of_a_long_chain_takes_few_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(trie, "cut", lambda df, cut=trie.cut: (written.append(1), cut(df))[1])
    nodes = spark.range(300).select("id").selectExpr("1L AS c", "id AS d", "IF(id = 0, NULL, 1L) AS pc", "id AS w")
    got = {r.d: r for r in trie.contract(nodes).collect()}
    assert [got[d].total for d in range(300)] == [sum(range(d, 300)) for d in range(300)]
    assert all(got[d].n_leaves == 1 and got[d].n_children == (d < 299) for d in range(300))
    assert len(written) < 40


def test_shortcut_proves_and_counts_as_the_library(spark, odd_docs, no_docs, monkeypatch):
    path = counts.default_path()
    library = counts.model(path)
    proven = counts.prove(path)
    assert all(len(library.encode(u[1:])) == 1 for u in proven if u != counts.BLANK) and len(proven) > 10_000
    counter, dice = counts.Counter(path, proven), random.Random(3)
    parts = ["a", "the", " ", "  ", "▁", "\n", "\t", "é", "漢", "😀", "\x00", "<s>", "</s>", "<unk>", "<0x41>", " ⁇ ", "x" * 50, "12", "\xa0", "　", "ing"]
    for piece in (7, 1 << 18):
        monkeypatch.setattr(counts, "PIECE", piece)
        for _ in range(2000):
            text = "".join(dice.choice(parts) for _ in range(dice.randrange(40)))
            assert counter.count(text) == len(library.encode(text)), text
    rows = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in counts.count_tokens(odd_docs).collect()}
    want = [(r.doc_id, r.text or "") for r in odd_docs.select("doc_id", "text").collect()]
    assert rows == {(i, len(t.encode()), len(library.encode(t)), len(library.encode(t)) > 4096) for i, t in want}
    assert any(r[3] for r in rows) and counts.count_tokens(odd_docs).count() == len(want)
    assert counts.count_tokens(no_docs).count() == 0


def plain_negatives(rows):
    out, known = [], []
    for n, (v, e, label) in enumerate(rows):
        if v is not None and label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            known.append((v, n, (label + 1) % 10 if v % 7 == 0 else label, [math.floor(256 * x) for x in e]))
    for v, n, label, e in known:
        if v % 100:
            continue
        others = sorted((-sum(a * b for a, b in zip(e, f)), w, m, l) for w, m, l, f in known if m != n and len(f) == len(e))
        for s, p, *_ in [o for o in others if o[3] == label][:5]:
            found = [o for o in others if o[3] != label and -30 * s <= -100 * o[0] <= -90 * s][:10]
            out += [(v, p, r + 1, o[1], -s, -o[0]) for r, o in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("group, leaf", [(40, 4), (hard.GROUP, hard.LEAF)])
def test_hard_negatives_equal_brute_force(spark, group, leaf):
    dice = np.random.default_rng(8)
    centres = dice.normal(size=(6, 5))
    rows = [(i, (centres[i % 6] + dice.normal(size=5) * 0.4).astype(np.float32).tolist(), int(dice.integers(3))) for i in range(900)]
    rows += [(1000 + i, [1.0, 1.0, 1.0, 1.0, 1.0], 2) for i in range(300)] + [(2000, [0.0] * 5, 1), (2100, [1.0, 2.0], 1), (2101, [1.0, 1.5], 1), (2102, [0.5, 1.0], 2), (2200, [], 1), (2201, [], 1)]
    rows += [(2300, None, 1), (2400, [1.0, None, 1.0, 1.0, 1.0], 1), (2500, [math.nan] * 5, 1), (2600, [math.inf] * 5, 1), (None, [1.0] * 5, 1), (2700, [1.0] * 5, None), (2800, [2.0] * 5, 1), (2800, [2.0] * 5, 1)]
    df = spark.createDataFrame([(v, e, l, 1, "x") for v, e, l in rows], "vec_id bigint, embedding array<float>, label int, own int, grp string")
    got = sorted(map(tuple, hard.hard_negatives(df, group, leaf).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))
    assert got == plain_negatives(rows) and len(got) > 300


def test_hard_negatives_of_no_rows_and_of_huge_components(spark):
    schema = "vec_id bigint, embedding array<double>, label int"
    assert hard.hard_negatives(spark.createDataFrame([], schema)).count() == 0
    x, y = np.array([[3e9, -7e9]]), np.array([[5e8 + 1, 3.0], [-(2.0**60), 0.0]])
    assert hard.products(x, y).tolist() == [[3_000_000_000 * 500_000_001 - 21_000_000_000 if abs(3_000_000_000 * 500_000_001) < hard.FAR else hard.FAR, -hard.FAR]]


def test_tree_skips_leaves_that_cannot_matter(spark):
    """Far clusters: a batch goes to few groups."""
    dice = np.random.default_rng(2)
    x = np.repeat(np.eye(8) * 40, 50, 0) + dice.normal(size=(400, 8)) * 0.1
    df = spark.createDataFrame([(i, v.tolist(), i // 50) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int")
    tree = hard.pack(hard.whole_vectors(df), 50, 8)
    nodes = hard.levels(tree)
    home = hard.at_home(tree, _first_asks(spark, tree), 5, True)
    pairs = hard.descend(home, nodes, True).count()
    assert pairs < home.count() * (tree.count() - 1) / 2


def _first_asks(spark, tree):
    rows = [(r.dim, r.grp, int(np.frombuffer(r.rows, np.int64)[0]), 0, -hard.FAR, hard.FAR) for r in tree.select("dim", "grp", "rows").collect()]
    return spark.createDataFrame(rows, "dim int, grp bigint, own bigint, slot bigint, low bigint, high bigint")
