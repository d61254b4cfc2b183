import itertools
import math
import os
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidegrid.llm import op1_context_mixing as mixing, op6_warc as warc, op8_toxicity as toxicity, op9_quality as quality
from tidegrid.llm.common import table, texts_of, tidy
from tidegrid.session import cut, scratch_root, small_batches

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fold(i):
    return -1 if i is None else crc32(str(i).encode()) % 5


def tokens(text):
    return [*WORD.findall((text or "").encode().translate(LOWER)), None]


@pytest.mark.parametrize("odd", [False, True])
def test_op1_base_score(spark, sf, odd_docs, odd):
    docs = odd_docs if odd else table(spark, sf, "documents")
    rows = [(r.doc_id, tokens(r.text)) for r in docs.select("doc_id", "text").collect()]
    c = Counter(w for i, ws in rows if fold(i) != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((i or -1, fold(i) == 1, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for i, ws in rows)
    found = mixing.score(docs, shards=3).collect()
    assert sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == [pytest.approx(w) for w in want]
    assert all(r.score <= 0 and r.score * -math.log2(10) == pytest.approx(r.bits) for r in found)


def test_op1_empty(no_docs):
    assert mixing.score(no_docs).count() == 0


def test_op1_stream_and_contexts():
    body, starts = texts_of(pa.array(["  The  CAT\tsat ", None, "", "é a", "\n"]))
    x, begin = mixing.stream(body, starts)
    texts = [x[a:b].tobytes().decode() for a, b in zip(begin[:-1], begin[1:])]
    assert texts == ["the cat sat\n", "\n", "\n", "é a\n", "\n"]
    alone = [mixing.contexts(x[a:b], np.array([0, b - a])) for a, b in zip(begin[:-1], begin[1:])]
    assert (np.concatenate(alone, axis=1) == mixing.contexts(x, begin)).all()  # nothing of another text


def test_op1_gives_probabilities():
    """The chances of all continuations of a text add up to one: the score is that of a distribution."""
    code = mixing.Code(np.bincount(np.frombuffer(b"abc abd\n", np.uint8), minlength=256))
    tables = np.random.default_rng(2).integers(-40, 40, (mixing.TABLES, 1 << mixing.BITS)).astype(np.int8)
    assert sum(2.0 ** -int(n) for n in code.lengths) == 1.0
    x = np.frombuffer(b"ab", np.uint8)
    score = lambda text: 10 ** mixing.score_texts(*texts_of(pa.array([text])), code, tables)[0]
    # Texts of no word or one word of one letter; then all longer ones share the rest.
    total = score("") + sum(score(chr(b)) for b in range(33, 127) if not 65 <= b <= 90)
    assert 0 < total < 1 and len(x) == 2


def test_op1_contexts_never_share_counts(spark):
    """As many contexts as the tables had slots: each keeps the counts of its own."""
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    x = np.concatenate([letters[np.random.default_rng(1).integers(0, 26, 3_000_000)], [mixing.END]]).astype(np.uint8)
    own = mixing.contexts(x, np.array([0, len(x)]))[1][5:]
    before = np.lib.stride_tricks.sliding_window_view(x, 5)[: len(own)].astype(np.int64) @ (256 ** np.arange(5))
    assert len(np.unique(own)) == len(np.unique(before))


def test_op1_odds_by_hand():
    code = mixing.Code(np.bincount(np.frombuffer(b"abcabcab", np.uint8), minlength=256))
    pairs = np.array([7 << 8 | 97, 7 << 8 | 98, 9 << 8 | 97], np.uint64)
    found, first = mixing.odds(pairs, np.array([3, 5, 2]), code)
    steps, lengths = code.expand(np.array([97, 98, 97], np.uint8))
    node = list(zip(np.repeat([7, 7, 9], lengths), (steps >> 1).tolist()))
    n = np.repeat([3, 5, 2], lengths)
    ones, zeros = Counter(), Counter()
    for key, step, c in zip(node, steps, n):
        (ones if step & 1 else zeros)[key] += int(c)
    assert found.tolist() == [max(-127, min(127, round(mixing.STEP * math.log((ones[k] + mixing.PRIOR) / (zeros[k] + mixing.PRIOR))))) for k in node]
    assert first.tolist() == [0, *np.cumsum(lengths).tolist()]


def test_op1_bytes_scored(spark, odd_docs):
    found = mixing.score(odd_docs).collect()
    want = sorted((i or -1, len(b" ".join(tokens(t)[:-1])) + 1) for i, t in ((r.doc_id, r.text) for r in odd_docs.collect()))
    assert sorted((r.doc_id or -1, r.bytes) for r in found) == want
    assert all(r.bits_per_byte == pytest.approx(r.bits / r.bytes) for r in found)


def test_op1_learns(spark, sf):
    found = mixing.score(table(spark, sf, "documents").where("doc_id IS NOT NULL"))
    row = found.groupBy("held_out").agg(F.sum("bits").alias("bits"), F.sum("base_score").alias("base"), F.sum("score").alias("score")).collect()
    held, trained = sorted(row, key=lambda r: not r.held_out)
    assert trained.score > trained.base and held.score > 1.25 * held.base


def test_op1_pieces_mixed_together_score_as_alone():
    rng, begin = np.random.default_rng(5), np.array([0, 3, 3 + 2 * mixing.LANE + 7, 2 * mixing.LANE + 11])
    held, alone = [], []
    for _ in range(3):
        lengths = rng.integers(1, 9, begin[-1])
        inputs = [rng.integers(-127, 128, lengths.sum()).astype(np.int8) for _ in range(mixing.TABLES)]
        steps = rng.integers(0, 2, lengths.sum())
        alone.append(mixing.mix_texts(inputs, begin, steps, lengths))
        held.append(([*inputs, steps.astype(np.int8)], mixing.lanes(begin, lengths)))
    assert np.array_equal(mixing.mix_pieces(held), np.concatenate(alone)) and not held


def test_op1_keys_without_counts():
    body, starts = texts_of(pa.array(["on and on it went", "", None, "On   and off"] * 9))
    for (keys, _), own in zip(mixing.distinct(body, starts, np.ones(len(starts) - 1, bool))[0], mixing.distinct_keys(body, starts)):
        assert np.array_equal(keys, own)


def test_op6_round_trip(spark, sf, tmp_path):
    import base64
    from hashlib import sha1
    odd = spark.createDataFrame([(1, None, None), (2, "u\r\n x", None), (None, "é", "<a>"), (None, None, "<a>"), (7, "a", "é" * 300_000), (8, "b", "<p>"), (9, "b", "<p>"), (9, "b", "<p>")],
                                "page_id bigint, url string, html string")
    for k, pages in enumerate((table(spark, sf, "pages"), odd, odd.limit(0))):
        rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
        largest = {}
        for i, b in rows:
            largest[b] = max(largest.get(b, -1), -1 if i is None else i)
        want = Counter()
        for i, b in rows:
            own = largest[b] in (i, -1)
            want[i, len(b), base64.b32encode(sha1(b).digest()).decode(), "response" if own else "revisit", None if own else largest[b]] += 1
        folder = f"file://{tmp_path}/{k}"
        files = warc.write_pages(pages, folder)
        for split in (997, warc.RANGE):
            found = warc.read_records(files, folder, split=split).collect()
            assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == want
            assert Counter(bytes(r.payload) for r in found if r.payload is not None) == Counter(b for i, b in rows if largest[b] in (i, -1))


def test_op6_small_payloads_are_never_revisits(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", "<p>") for i in range(3)], "page_id bigint, url string, html string")
    files = warc.write_pages(pages, f"file://{tmp_path}/w", min_bytes=4)
    assert {r.record_type for r in warc.read_records(files, f"file://{tmp_path}/w").collect()} == {"response"}


def test_op8_marginals_equal_enumeration():
    random = np.random.default_rng(0)
    lengths, moves = np.array([5, 1, 0, 3, 7]), random.normal(size=(2, 2))
    score = random.normal(size=lengths.sum()) * 2
    p, pairs = toxicity.marginals(score, lengths, moves, True)
    want, moved, at = [], np.zeros((2, 2)), 0
    for n in lengths:
        total, own, steps = 0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(score[at + i] * y[i] for i in range(n)) + sum(moves[y[i - 1], y[i]] for i in range(1, n)))
            total, own = total + w, own + w * np.array(y)
            for i in range(1, n):
                steps[y[i - 1], y[i]] += w
        want, moved, at = [*want, *(own / total)], moved + steps / total, at + n
    assert p == pytest.approx(want) and pairs == pytest.approx(moved)


def made(spark, n=600):
    """Clean words of syllables; every fourth document has rude words in any place."""
    random = np.random.default_rng(5)
    syllables = ["ra", "to", "ni", "ke", "lo", "mu", "sa", "di"]
    rows, labels = [], []
    for i in range(n):
        words = ["".join(random.choice(syllables, random.integers(1, 4))) for _ in range(random.integers(8, 60))]
        toxic = i % 4 == 0
        for _ in range(3 * toxic):
            words.insert(random.integers(len(words)), str(random.choice(["Blarg", "wibbo!", "snurf"])))
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_op8_held_out_accuracy_and_spans(spark):
    docs, labels = made(spark)
    found = toxicity.classify(docs, toxicity.learn(docs, labels)).collect()
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert {r.doc_id for r in found if r.held_out} == {i for i in text if fold(i) == 0}
    assert all(r.predicted == (r.doc_id % 4 == 0) for r in found)
    assert {w for r in found for s in r.spans for w in text[r.doc_id][s.begin : s.end].lower().replace(b"!", b"").split()} == {b"blarg", b"wibbo", b"snurf"}
    kept = toxicity.keep_clean(docs, toxicity.learn(docs, labels))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in text if i % 4}


def test_op8_odd_rows(spark, odd_docs, no_docs):
    docs, labels = made(spark, 200)
    field = toxicity.learn(docs, labels.withColumn("toxic", F.when(F.col("doc_id") % 7 != 0, F.col("toxic"))))
    found = toxicity.classify(odd_docs, field).collect()
    assert len(found) == odd_docs.count() and all(r.score == 0 for r in found if r.doc_id in (1, 2, 3))
    assert toxicity.classify(no_docs, field).count() == 0
    nothing = toxicity.learn(docs, labels.limit(0))
    assert all(r.score < 0.01 and r.predicted == 0 for r in toxicity.classify(docs, nothing).collect())


def plain_kneser_ney(texts):
    """p(gram) of a modified Kneser-Ney model of byte 5-grams, said with dictionaries."""
    def grams_of(text):
        x = b"\xff" * 4 + bytes(b | 32 if 65 <= b <= 90 else b for b in (text or "").encode()) + b"\xff"
        return [x[i : i + 5] for i in range(len(x) - 4)]

    seen = {5: Counter(g for t in texts for g in grams_of(t))}
    for k in (4, 3, 2, 1):
        seen[k] = Counter(g[1:] for g in seen[k + 1])
    off = {}
    for k in seen:
        n = [max(1, sum(v == i for v in seen[k].values())) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        off[k] = [0] + [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.05), i) for i in (1, 2, 3)]
    follow = {k: {} for k in seen}
    for k in seen:
        for g, v in seen[k].items():
            follow[k].setdefault(g[:-1], []).append(v)

    def p(g):
        if not g:
            return 1 / 256
        after = follow[len(g)].get(g[:-1])
        if not after:
            return p(g[1:])
        d, v = off[len(g)], seen[len(g)].get(g, 0)
        return (v - d[min(v, 3)]) / sum(after) + sum(d[min(v, 3)] for v in after) / sum(after) * p(g[1:])

    return p, grams_of


def test_op9_bits_of_every_document_equal_a_plain_model(spark, odd_docs):
    docs, labels = made(spark, 60)
    short = odd_docs.where("doc_id IS NULL OR doc_id NOT IN (4, 10)").select("doc_id", "text", "lang", "source", "n_chars").withColumn("doc_id", F.col("doc_id") + 5000)
    every = docs.union(short)
    trusted = labels.where("doc_id % 3 != 0").select("doc_id").union(spark.createDataFrame([(5002,), (5011,), (9999,)], "doc_id bigint"))
    rows = every.collect()
    ids = {r.doc_id for r in trusted.collect()}
    p, grams_of = plain_kneser_ney([r.text for r in rows if r.doc_id in ids and fold(r.doc_id) != 0])
    want = sorted((r.doc_id or -1, sum(-math.log2(p(g)) for g in grams_of(r.text)) / len(grams_of(r.text))) for r in rows)
    for size in (2_000, 8 << 20):  # many slices, shards and blocks, or one
        found = quality.score(every.select(F.struct("doc_id", "lang", "text").alias("row")), trusted, size=size).collect()
        got = sorted((r.doc_id or -1, r.bits_per_byte) for r in found)
        assert [i for i, _ in got] == [i for i, _ in want] and [b for _, b in got] == pytest.approx([b for _, b in want], abs=3e-3)
    # What may follow a context adds up to one.
    assert sum(p(b"ra t"[-4:] + bytes([b])) for b in range(256)) == pytest.approx(1)


def test_op9_a_text_of_many_megabytes_is_one_slice_of_bounded_pieces(spark):
    docs = spark.createDataFrame([(1, "en", "on and on it went " * 700_000), (2, "en", "on and on"), (3, "en", None)], "doc_id bigint, lang string, text string")
    trusted = spark.createDataFrame([(1,), (2,)], "doc_id bigint")
    bits = {r.doc_id: r.bits_per_byte for r in quality.score(docs.select(F.struct(*docs.columns).alias("row")), trusted).collect()}
    assert set(bits) == {1, 2, 3} and bits[1] < bits[2] < bits[3]


def test_op9_keeps_good_text_and_rejects_noise(spark, odd_docs, no_docs):
    docs, labels = made(spark, 400)
    noise = spark.createDataFrame([(1000 + i, t, "en", "s", 0) for i, t in enumerate(["%$# @@ ^^ && " * 20, "raraRARArara ra " * 60, "qxz jvw kqx zzq wvj " * 20])], docs.schema)
    found = {r.doc_id: r.kept for r in quality.classify(docs.union(noise), labels).collect()}
    assert sum(found[i] for i in range(400)) >= 396 and not found[1000] and not found[1002]
    kept = quality.keep_good(odd_docs.withColumns({"low": F.lit("l"), "kept": F.lit(3), "bits_per_byte": F.lit("b")}), labels)
    assert kept.count() <= odd_docs.count() and kept.columns[-3:] == ["low", "kept", "bits_per_byte"]
    assert all((r.low, r.kept, r.bits_per_byte) == ("l", 3, "b") for r in kept.select("low", "kept", "bits_per_byte").collect())
    assert quality.classify(no_docs, labels).count() == 0 and quality.classify(odd_docs, labels.limit(0)).where("kept").count() == odd_docs.count()


def test_op9_texts_reach_python_in_small_batches(spark, odd_docs, monkeypatch):
    written, cut = [], quality.cut
    monkeypatch.setattr(quality, "cut", lambda df: written.append((df.columns, int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))) or cut(df))
    labels = made(spark, 40)[1]
    assert quality.classify(odd_docs, labels).count() == odd_docs.count()
    assert quality.keep_good(odd_docs, labels).count() <= odd_docs.count()
    texts = [rows for columns, rows in written if "bits_per_byte" in columns and "unseen" not in columns or "keys" in columns]
    assert len(texts) == 4 and max(texts) <= 1000


def test_pipeline_stages_leave_only_their_result(spark, sf):
    docs = table(spark, sf, "documents").limit(50)
    folder = f"{scratch_root(spark)}/tidegrid-{spark.sparkContext.applicationId}".removeprefix("file://")
    for _, stage in corpus_pipeline.STAGES:
        before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
        result = stage(spark, docs, sf)
        left = set(os.listdir(folder)) - before
        assert len(left) == 1 and all(left.copy().pop() in f for f in result.inputFiles()) and result.count() > 0


def test_pipeline_stages_hand_out_what_is_written(spark, sf):
    docs = table(spark, sf, "documents").limit(50)
    for _, stage in corpus_pipeline.STAGES:
        assert "InArrow" not in stage(spark, docs, sf)._jdf.queryExecution().executedPlan().toString()


def test_a_task_gives_back_the_memory_it_freed():
    kept = []

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    def work(rows):
        held = [np.ones(60_000, np.uint8) for _ in range(4000)]
        kept.append(np.ones(60_000, np.uint8))  # above what is freed, so that it isn't given back by itself
        return rows, len(held)

    def task(batches):
        for batch in batches:
            yield work(batch)

    before = resident()
    assert list(tidy(task)(iter([1, 2]))) == [(1, 4000), (2, 4000)] and resident() - before < 100e6
    assert tidy(lambda group: work(group))("g") == ("g", 4000) and resident() - before < 100e6
    assert tidy(lambda left, right: work((left, right)))("l", "r") == (("l", "r"), 4000) and resident() - before < 100e6


def test_written_texts_lie_in_small_row_groups(spark):
    texts = spark.range(0, 40_000, 1, 1).select("id", F.concat(*[F.sha2(F.concat("id", F.lit(f"-{i}")), 256) for i in range(16)]).alias("text"))
    written = cut(texts)
    assert written.count() == 40_000 and written.dtypes == texts.dtypes
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in written.inputFiles()]
    assert max(m.row_group(g).total_byte_size for m in files for g in range(m.num_row_groups)) < 20 << 20


def test_small_batches_hold_for_python_and_parquet(spark):
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = [spark.conf.get(n) for n in names]
    with small_batches(spark):
        assert [int(spark.conf.get(n)) for n in names] == [1000, 1000]
    assert [spark.conf.get(n) for n in names] == before


def test_pipeline_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "packing"]
    before = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, sf))
        after = [r.doc_id for r in docs.select("doc_id").collect()]
        assert docs.columns == columns and len(after) == len(set(after)) and set(after) <= before and len(after) > 0.6 * len(before)
        before = set(after)
    text = {r.doc_id: r.text for r in docs.collect()}
    sets = {i: frozenset(tuple(w[k : k + 5]) for w in [tokens(t)[:-1]] for k in range(max(1, len(w) - 4))) for i, t in text.items()}
    assert not [(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    packed = corpus_pipeline.packing(spark, docs, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(text)


def test_op1_rows_go_to_their_shards_unwritten(spark, odd_docs, monkeypatch):
    written, cut = [], mixing.cut
    monkeypatch.setattr(mixing, "cut", lambda df: written.append(df.columns) or cut(df))
    assert mixing.score(odd_docs).count() == odd_docs.count()
    assert written and not any("keys" in columns for columns in written)
