import random
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidegrid.llm import bpe, op4_packing, op5_bpe, op10_token_files
from tidegrid.llm.common import table

PARTS = ["a", "b", "the", "in", " ", "  ", "\n", "'", "s", "re", "ll", "1", "23", "²", "Ⅷ", "é", "ß", "漢", "字", "😀", "<|endoftext|>", "<|endo", "!", "&&&", "　", "\x85", "_", "́"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def merges():
    return bpe.own(bpe.default_path())[0]


def ids_of(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4")


def stream(merges, text, step):
    encoder = bpe.StreamingEncoder(merges)
    out = [encoder.push(text[i : i + step]) for i in range(0, len(text), step)]
    return np.frombuffer(b"".join([*out, encoder.finish()]), "<u4").tolist()


@pytest.mark.parametrize("step", [1, 3, 10**6])
def test_chunks_of_any_size_encode_like_the_library(library, merges, step):
    choose = random.Random(step)
    for _ in range(300):
        text = "".join(choose.choice(PARTS) for _ in range(choose.randint(0, 40)))
        assert stream(merges, text, step) == ids_of(library, text).tolist(), text


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 9_000 + " x", " " * 9_000 + "x", "\n" * 7_000 + " y", "!" * 9_001 + "'s", "漢字" * 5_000, "12345" * 4_000 + "²",
                                  "".join(random.Random(5).choice("etaoinshr") for _ in range(30_000))])
def test_endless_pieces_need_one_window(library, merges, text):
    for step in (700, 10**6):
        assert stream(merges, text, step) == ids_of(library, text).tolist()


def test_lookahead_is_enough_inside_a_piece(merges):
    choose = random.Random(9)
    for _ in range(40):
        text = "".join(choose.choice("abcdeht ionsr"[: choose.randint(3, 13)]) for _ in range(4_000)).replace(" ", "e").encode()
        ids, rest = merges.stable(text)
        assert ids + merges.merge(rest) == merges.merge(text) and len(rest) <= merges.window


def test_decoder_holds_back_half_a_character(library, merges):
    text = "漢字 😀 é" * 20
    decoder = bpe.Decoder(merges)
    parts = [decoder.push([i]) for i in ids_of(library, text).tolist()]
    assert "".join(parts) + decoder.finish() == text and "�" not in "".join(parts)
    broken = bpe.Decoder(merges)
    ids = ids_of(library, "漢").tolist()[:1]
    assert broken.push(ids) + broken.finish() == library.decode(ids, skip_special_tokens=False)


def test_op5_equals_the_library(spark, sf, library, odd_docs):
    for docs in (table(spark, sf, "documents"), odd_docs):
        want = sorted((r.doc_id or -1, len(i := ids_of(library, r.text)), sha256(i.tobytes()).hexdigest(), sha256(library.decode(i.tolist(), skip_special_tokens=False).encode()).hexdigest())
                      for r in docs.select("doc_id", "text").collect())
        assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op5_bpe.round_trip(docs).collect()) == want


def test_op5_general_interface(odd_docs, no_docs):
    back = op5_bpe.decode(op5_bpe.encode(odd_docs), text="again").select("text", "again").collect()
    assert all((r.text or "") == r.again for r in back)
    assert op5_bpe.encode(no_docs).count() == 0


def check_packing(library, docs, pieces):
    want = sorted((r.doc_id or -1, len(i := np.append(ids_of(library, r.text), 0).astype("<u4")), crc32(i.tobytes())) for r in docs.select("doc_id", "text").collect())
    assert sum(p.length for p in pieces) == sum(n for _, n, _ in want)
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault((p.doc_id or -1, p.doc_tokens), []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert {(d, n) for d, n, _ in want} == set(by_doc)
    ids = {(r.doc_id or -1, len(i)): i for r in docs.select("doc_id", "text").collect() for i in [np.append(ids_of(library, r.text), 0).astype("<u4")]}
    for (d, n), own in by_doc.items():
        assert all(crc32(ids[d, n][p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in own)
        copies = sum(1 for e, m, _ in want if (e, m) == (d, n))
        if copies == 1:
            assert sorted((p.start, p.start + p.length) for p in own) == [(a, b) for a, b in zip([0, *(sorted(p.start + p.length for p in own)[:-1])], sorted(p.start + p.length for p in own))]
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= op4_packing.CAPACITY
    return by_sequence


def test_op4_packs_every_id_once(spark, sf, library, odd_docs, no_docs):
    check_packing(library, odd_docs, op4_packing.pack(odd_docs).collect())
    docs = table(spark, sf, "documents")
    pieces = op4_packing.pack(docs).collect()
    by_sequence = check_packing(library, docs, pieces)
    assert sum(p.length for p in pieces) > 0.99 * 1024 * (len(by_sequence) - 1)
    assert op4_packing.pack(no_docs).count() == 0


def test_op4_takes_the_cheapest_sequence_with_room():
    assert op4_packing.assign([6, 5, 3, 2], 8) == [(0, 0, 6, 0, 0), (1, 0, 5, 1, 0), (2, 0, 3, 1, 5), (3, 0, 2, 0, 6)]
    assert op4_packing.assign([20], 8) == [(0, 0, 8, 0, 0), (0, 8, 8, 1, 0), (0, 16, 4, 2, 0)]
    cut = op4_packing.assign([5, 5, 6], 8)
    assert sorted((d, s, n) for d, s, n, _, _ in cut) == [(0, 0, 5), (1, 0, 3), (1, 3, 2), (2, 0, 6)]


def test_op10_files(spark, sf, library, odd_docs, no_docs, tmp_path):
    for k, docs in enumerate((table(spark, sf, "documents"), odd_docs, no_docs)):
        folder = f"file://{tmp_path}/{k}"
        op10_token_files.write_tokens(docs, folder)
        read = op10_token_files.read_tokens(spark, folder)
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
        at, want = 0, []
        for d, t in rows:
            i = np.append(ids_of(library, t), 2).astype("<u4")
            want.append((d, at, len(i), crc32(i.tobytes())))
            at += len(i)
        got = [tuple(r) for r in op10_token_files.layout(read).orderBy("start").collect()]
        assert got == want
        if k == 0:
            one = op10_token_files.read_tokens(spark, folder, "doc_id = 7")
            assert [r.ids for r in one.collect()] == [np.append(ids_of(library, dict(rows)[7]), 2).tolist()]
            assert "EqualTo(doc_id,7)" in one._jdf.queryExecution().toString()


def test_op10_files_are_ordered_by_part_number(spark):
    rows = [("f/part-100000-a.orc", 3, 0, [7, 2]), ("f/part-99999-a.orc", 1, 0, [5, 6, 2]), ("f/part-99999-a.orc", 2, 1, [2])]
    read = spark.createDataFrame(rows, "file string, doc_id bigint, ordinal bigint, ids array<int>")
    assert {r.doc_id: r.start for r in op10_token_files.layout(read).collect()} == {1: 0, 2: 3, 3: 4}
