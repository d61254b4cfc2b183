"""Quality by an interpolated modified Kneser-Ney model of byte 5-grams, trained on trusted text.

A text is its bytes, A-Z in lower case, with four borders before it and one after; the border is 0xFF, which UTF-8
never holds. Every byte counts as itself, so letters of all scripts are told apart and short words are seen whole.

Nothing of the model has a fixed size or is broadcast. Documents are dealt by doc_id into slices of about ``SLICE``
bytes, where they meet the ids of trusted documents. A slice sends its distinct 5-grams with their counts in trusted text to
shards, and the distinct grams and contexts of all orders in all its texts as requests. Counts, continuation counts
of the lower orders, contexts and probabilities are rows, made by grouping and joining them by gram: a gram has at most 256
followers and 256 longer forms, so no key of these joins is hot. D1, D2 and D3+ of each order come from the counts of counts;
the last order is interpolated with the uniform distribution. Shards join the requests with the finished rows and reply
to each slice; there every text meets its replies, and its bits per byte (the logarithm of its perplexity) is the mean.

A fifth of the trusted documents (``crc32(doc_id) mod 5 = 0``) doesn't train. Kept are documents between the ``LOW``
quantile of all trusted documents of their language and the ``HIGH`` quantile of those that didn't train, widened by
``SLACK`` over the root of their number: below are repetitions, above is noise. A language (null is one) with
fewer than ``FEW`` trusted documents outside the training uses the quantiles of all languages; ``own_limits`` tells.

Null text counts as empty, with the bits of an end alone; it is kept or rejected by the same quantiles. A null doc_id is
never trusted. Without trusted documents everything is kept, and every byte has 8 bits. Rows repeat as they come.
``keep_good`` returns extra columns as they are, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidegrid.llm.common import LOWER, fold, fold_of, slices, table, texts_of, tidy, wrapped
from tidegrid.llm.op1_context_mixing import Index
from tidegrid.session import cut, small_batches

ORDER, BORDER = 5, 0xFF
LEVEL = 48  # a key is a gram's length above this bit, its bytes below
SLICE, PIECE, HELD = 8 << 20, 1 << 20, 32 << 20
KEYS = 300_000  # about the distinct grams of a slice, used to size groups alone
LOW, HIGH, SLACK, FEW = 0.002, 0.998, 0.3, 30
SCALE = 1000.0  # steps of a bit
SPREAD = 1_000_003

GATHERED = "slice long, shard int, part int, trained boolean, keys binary, counts binary"


def grams(column) -> tuple[np.ndarray, np.ndarray]:
    """The 5-gram that ends at every byte and at the end of every row, and where each row's begin (the last: the end)."""
    body, starts = texts_of(column)
    ahead = ORDER - 1
    begin = starts + (ahead + 1) * np.arange(len(starts))
    raw = np.full(int(begin[-1]), BORDER, np.uint8)
    wanted = np.ones(len(raw), bool)
    for j in range(ahead):
        wanted[begin[:-1] + j] = False
    text = wanted.copy()
    text[begin[1:] - 1] = False
    raw[text] = LOWER[body]
    two = raw[1:].astype(np.int32) | raw[:-1].astype(np.int32) << 8
    four = two[2:].astype(np.int64) | two[:-2].astype(np.int64) << 16
    codes = four[1:] | raw[:-ahead].astype(np.int64) << 32
    return codes[wanted[ahead:]], starts + np.arange(len(starts))


def levels(top: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct grams of length 0 to ORDER: ``top``, and all endings and contexts of what is one longer."""
    out = [top]
    for k in range(ORDER - 1, -1, -1):
        out.append(np.unique(np.concatenate([out[-1] & ((1 << 8 * k) - 1), out[-1] >> 8])))
    return out[::-1]


def bits_of(top: np.ndarray, known: list[np.ndarray], own: list[np.ndarray], back: list[np.ndarray]) -> np.ndarray:
    """Steps of every 5-gram: its own where it was seen (0 or more), else those of its context and its ending."""
    out, passed = np.full(len(top), -1, np.int32), np.zeros(len(top), np.int32)
    for k in range(ORDER, 0, -1):
        rest = np.flatnonzero(out < 0)
        gram = top[rest] & ((1 << 8 * k) - 1)
        found = own[k][np.searchsorted(known[k], gram)]
        seen = found >= 0
        out[rest[seen]] = passed[rest[seen]] + found[seen]
        passed[rest] += back[k - 1][np.searchsorted(known[k - 1], gram >> 8)]
    return np.where(out < 0, passed + int(8 * SCALE), out)


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte by byte of all, compressed."""
    return zlib.compress(np.diff(keys, prepend=0).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T.copy().view(np.int64).reshape(-1))


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    every, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(every, kind="stable")
    every, n = every[order], n[order]
    begin = np.flatnonzero(np.diff(every, prepend=-1))
    return every[begin], np.add.reduceat(n, begin) if len(begin) else n


def _dealt(keys: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    shard = keys % SPREAD % shards
    order = np.argsort(shard, kind="stable")
    ends = np.cumsum(np.bincount(shard, minlength=shards))
    for s in range(shards):
        if (at := order[ends[s - 1] if s else 0 : ends[s]]).size:
            yield s, at


def dealing(docs: DataFrame, size: int = SLICE) -> tuple[int, int, int]:
    """Numbers of slices, shards and parts of a shard, from the bytes of all texts."""
    total = docs.agg(F.sum(F.octet_length("text").cast("long") + 1)).first()[0] or 1
    n = -(-total // size)
    shards = 4 * int(np.ceil(np.sqrt(n)))
    return n, shards, -(-n * KEYS // (shards << 22))


def _slice(doc_id: Column, text: Column | None, n: int) -> Column:
    hashed = F.xxhash64(doc_id.cast("string"))
    return F.pmod(hashed if text is None else F.when(doc_id.isNull(), F.xxhash64(text)).otherwise(hashed), F.lit(n))


def blocks(docs: DataFrame, n: int) -> DataFrame:
    """(slice, block): the rows of ``docs(row)`` as compressed Arrow streams, one or more for each slice."""
    def pack(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > HELD:
                yield from flush(held)
                held, size = [], 0
        yield from flush(held)

    def flush(held):
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()  # once, not once for each slice
        held.clear()
        # Rows larger than a piece go alone, so that whoever reads a block holds little more than one text.
        for s, at in _dealt_rows(rows["slice"].to_numpy()):
            for part in _runs(rows["row"].take(pa.array(at)).combine_chunks()):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, pa.schema([("row", part.type)]), options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
                    out.write_batch(pa.RecordBatch.from_arrays([part], ["row"]))
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["slice", "block"])

    dealt = docs.select(_slice(F.col("row.doc_id"), F.col("row.text"), n).alias("slice"), "row")
    return dealt.mapInArrow(tidy(pack), "slice long, block binary")


def _dealt_rows(s: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(s, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(s[order])) + 1):
        yield int(s[at[0]]), at


def _runs(rows: pa.StructArray) -> Iterator[pa.StructArray]:
    if isinstance(rows, pa.ChunkedArray):
        rows = pa.concat_arrays(rows.chunks)
    batch = pa.RecordBatch.from_arrays([rows, _text(rows)], ["row", "text"])
    for part in slices([batch], "text", SLICE // 2):
        yield pa.concat_arrays([part["row"]])


def _text(rows: pa.StructArray) -> pa.Array:
    return pc.struct_field(rows, "text")


def _pieces(group: pa.Table) -> Iterator[pa.RecordBatch]:
    """The rows of a slice as (row, text), about ``PIECE`` bytes of text at a time."""
    for block in group["block"]:
        for batch in pa.ipc.open_stream(pa.py_buffer(block.as_py())):
            whole = pa.RecordBatch.from_arrays([batch["row"], _text(batch["row"])], ["row", "text"])
            yield from slices([whole], "text", PIECE)


def gather(packed: DataFrame, trusted: DataFrame, n: int, shards: int, parts: int) -> DataFrame:
    """Counts in trusted text outside the held-out fifth, and requests, of each slice, for each shard."""
    def run(group: pa.Table, ids: pa.Table) -> pa.Table:
        train = pa.array([i for i in ids["doc_id"].to_pylist() if fold_of(i) != 0], ids["doc_id"].type)
        seen, keys, counts = [], [], []
        for piece in _pieces(group):
            codes, first = grams(piece["text"])
            seen.append(np.unique(codes))
            wanted = pc.is_in(pc.struct_field(piece["row"], "doc_id").cast(train.type), value_set=train).to_numpy(zero_copy_only=False)
            if wanted.any():
                found, many = np.unique(codes[np.repeat(wanted, np.diff(first))], return_counts=True)
                keys.append(found)
                counts.append(many)
            if len(seen) > 8:
                seen = [np.unique(np.concatenate(seen))]
                if keys:
                    keys, counts = ([a] for a in _merged(keys, counts))
        if not seen:
            return EMPTY.empty_table()
        number = group["slice"][0].as_py()
        found, many = _merged(keys, counts)
        known = levels(np.unique(np.concatenate(seen)))
        rows = [(number, s, number % parts, True, _packed(found[at]), zlib.compress(many[at].astype(np.int64).tobytes(), 1)) for s, at in _dealt(found, shards)]
        asked = _keys(known)
        rows += [(number, s, number % parts, False, _packed(asked[at]), None) for s, at in _dealt(asked, shards)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), EMPTY)], schema=EMPTY)

    own = trusted.select("doc_id", _slice(F.col("doc_id"), None, n).alias("slice"))
    return cut(packed.groupBy("slice").cogroup(own.groupBy("slice")).applyInArrow(tidy(run), GATHERED))


EMPTY = pa.schema([("slice", pa.int64()), ("shard", pa.int32()), ("part", pa.int32()), ("trained", pa.bool_()), ("keys", pa.binary()), ("counts", pa.binary())])


def _keys(known: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([grams_of + (k << LEVEL) for k, grams_of in enumerate(known)])


def counted(gathered: DataFrame) -> DataFrame:
    """(gram, n): counts of the 5-grams of all trusted text that trains."""
    def add(group: pa.Table) -> pa.Table:
        keys = [_unpacked(k.as_py()) for k in group["keys"]]
        found, n = _merged(keys, [np.frombuffer(zlib.decompress(c.as_py()), np.int64) for c in group["counts"]])
        return pa.table({"gram": found, "n": n})

    summed = gathered.where("trained").select("shard", "part", "keys", "counts").groupBy("shard", "part").applyInArrow(tidy(add), "gram long, n long")
    return summed.groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(n: list[int]) -> list[float]:
    """D for counts of 0, 1, 2 and 3 or more, from the numbers of grams seen 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = np.maximum(np.array(n, float), 1)
    y = n1 / (n1 + 2 * n2)
    return np.clip([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], [0, 0.05, 0.05, 0.05], [0, 1, 2, 3]).tolist()


def train(counts: DataFrame) -> DataFrame:
    """(key, own, back): bits of every gram seen, and bits of leaving every context seen."""
    # Continuation counts: how many different bytes come before a shorter gram.
    seen = {ORDER: cut(counts)}
    for k in range(ORDER - 1, 0, -1):
        seen[k] = cut(seen[k + 1].groupBy(F.col("gram").bitwiseAND((1 << 8 * k) - 1).alias("gram")).agg(F.count("*").alias("n")))
    times = [F.sum(F.when(F.col("n") == i, 1).otherwise(0)).alias(f"n{i}") for i in (1, 2, 3, 4)]
    lower, out = None, None
    for k in range(1, ORDER + 1):
        d = discounts([v or 0 for v in seen[k].agg(*times).first()])
        off = F.when(F.col("n") == 1, d[1]).when(F.col("n") == 2, d[2]).otherwise(d[3])
        rows = seen[k].select("gram", "n", off.alias("off"), F.shiftright("gram", 8).alias("context"), F.col("gram").bitwiseAND((1 << 8 * (k - 1)) - 1).alias("ending"))
        left = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum("off").alias("off_all")).select("context", "total", (F.col("off_all") / F.col("total")).alias("left"))
        rows = rows.join(left, "context")
        rows = rows.withColumn("lower", F.lit(1 / 256)) if lower is None else rows.join(lower.select(F.col("gram").alias("ending"), F.col("p").alias("lower")), "ending")
        lower = cut(rows.select("gram", ((F.col("n") - F.col("off")) / F.col("total") + F.col("left") * F.col("lower")).alias("p")))
        half = lower.select((F.col("gram") + (k << LEVEL)).alias("key"), (-F.log2("p")).alias("own"), F.lit(None).cast("double").alias("back")).unionByName(
            left.select((F.col("context") + ((k - 1) << LEVEL)).alias("key"), F.lit(None).cast("double").alias("own"), (-F.log2("left")).alias("back")))
        out = half if out is None else out.unionByName(half)
    return out.groupBy("key").agg(F.max("own").alias("own"), F.max("back").alias("back"))


def replies(gathered: DataFrame, model: DataFrame, shards: int, parts: int) -> DataFrame:
    """(slice, shard, own, back): steps for the keys that a slice asked a shard for, in their order; -1 and 0 if unseen."""
    def answer(asked: pa.Table, rows: pa.Table) -> pa.Table:
        order = np.argsort(rows["key"].to_numpy())
        keys = np.append(rows["key"].to_numpy()[order], np.int64(1) << 62)
        own, back = (np.append(_steps(rows[c], none)[order], np.int16(none)) for c, none in (("own", -1), ("back", 0)))
        out = []
        for number, shard, data in zip(asked["slice"].to_pylist(), asked["shard"].to_pylist(), asked["keys"]):
            wanted = _unpacked(data.as_py())
            at = np.searchsorted(keys, wanted)
            at = np.where(keys[at] == wanted, at, len(keys) - 1)
            out.append((number, shard, zlib.compress(own[at].tobytes(), 1), zlib.compress(back[at].tobytes(), 1)))
        return pa.table(list(zip(*out)) if out else [[], [], [], []], pa.schema([("slice", pa.int64()), ("shard", pa.int32()), ("own", pa.binary()), ("back", pa.binary())]))

    shard = (F.col("key") % SPREAD % shards).cast("int")
    copies = model.select("key", "own", "back", shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    asked = gathered.where("NOT trained").select("slice", "shard", "part", "keys")
    return cut(asked.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInArrow(tidy(answer), "slice long, shard int, own binary, back binary"))


def _steps(bits: pa.ChunkedArray, none: int) -> np.ndarray:
    return np.round(pc.fill_null(pc.multiply(bits, SCALE), none).to_numpy().clip(-1, 32_000)).astype(np.int16)


def score(docs: DataFrame, trusted: DataFrame, whole: bool = False, size: int = SLICE) -> DataFrame:
    """(doc_id, lang, bits_per_byte) of every row of ``docs(row)``, with the row itself if ``whole``."""
    n, shards, parts = dealing(docs.select("row.text"), size)
    packed = blocks(docs, n)
    gathered = gather(packed, trusted, n, shards, parts)
    answers = replies(gathered, train(counted(gathered)), shards, parts)
    names = [*(["row"] if whole else []), "doc_id", "lang", "bits_per_byte"]

    def run(group: pa.Table, answer: pa.Table) -> pa.Table:
        # The grams of the slice are found again in their order, so replies carry no keys.
        seen = []
        for piece in _pieces(group):
            seen.append(np.unique(grams(piece["text"])[0]))
            if len(seen) > 8:
                seen = [np.unique(np.concatenate(seen))]
        known = levels(np.unique(np.concatenate(seen)))
        asked = _keys(known)
        got = {s: (o.as_py(), b.as_py()) for s, o, b in zip(answer["shard"].to_pylist(), answer["own"], answer["back"])}
        own, back = np.empty(len(asked), np.int16), np.empty(len(asked), np.int16)
        for s, at in _dealt(asked, shards):
            own[at], back[at] = (np.frombuffer(zlib.decompress(v), np.int16) for v in got[s])
        ends = np.cumsum([len(k) for k in known])[:-1]
        bits = bits_of(known[-1], known, np.split(own, ends), np.split(back, ends))
        out, places = [], Index(known[-1].view(np.uint64))
        for piece in _pieces(group):
            codes, first = grams(piece["text"])
            sums = np.add.reduceat(bits[places.find(codes.view(np.uint64))].astype(np.int64), first[:-1])
            row = piece["row"]
            columns = [pc.struct_field(row, "doc_id"), pc.struct_field(row, "lang"), pa.array(sums / SCALE / np.diff(first))]
            out.append(pa.RecordBatch.from_arrays([*([row] if whole else []), *columns], names))
        return pa.Table.from_batches(out)

    schema = docs.select(*(["row"] if whole else []), F.col("row.doc_id").alias("doc_id"), F.col("row.lang").alias("lang")).schema.add("bits_per_byte", "double")
    return packed.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(tidy(run), schema)


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()


def limits(scored: DataFrame, trusted: DataFrame, low: float = LOW, high: float = HIGH, slack: float = SLACK, few: int = FEW) -> tuple[DataFrame, tuple[float, float]]:
    """(lang, low, high) of the languages with enough trusted documents, and the limits of all."""
    out = fold(F.col("doc_id")) == 0
    # The same join at every size, so that its cost stays in proportion.
    known = cut(scored.join(trusted.hint("merge"), "doc_id", "left_semi").select("lang", "bits_per_byte", F.when(out, F.col("bits_per_byte")).alias("unseen")))
    wide = lambda n: slack / F.sqrt(F.greatest(n, F.lit(1)))
    top = F.coalesce(F.percentile_approx("unseen", high, 100_000), F.percentile_approx("bits_per_byte", high, 100_000))
    marks = [F.count("unseen").alias("n"), (F.percentile_approx("bits_per_byte", low, 100_000) * (1 - wide(F.count("*")))).alias("low"), (top * (1 + wide(F.count("unseen")))).alias("high")]
    whole = known.agg(*marks).first()
    every = (whole["low"], whole["high"]) if whole["low"] is not None else (float("-inf"), float("inf"))
    return known.groupBy("lang").agg(*marks).where(F.col("n") >= few).select("lang", "low", "high"), every


def judge(scored: DataFrame, found: tuple[DataFrame, tuple[float, float]]) -> DataFrame:
    """Adds low, high, own_limits and kept."""
    per, (low, high) = found
    per = per.select(F.col("lang").alias("_lang"), F.col("low").alias("_low"), F.col("high").alias("_high"))
    out = scored.join(per, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    out = out.withColumns({"low": F.coalesce("_low", F.lit(low)), "high": F.coalesce("_high", F.lit(high)), "own_limits": F.col("_low").isNotNull()}).drop("_lang", "_low", "_high")
    return out.withColumn("kept", F.col("bits_per_byte").between(F.col("low"), F.col("high")))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, bits_per_byte, low, high, own_limits, kept) of every document."""
    trusted = cut(trusted_ids(labels))
    with small_batches(docs.sparkSession):
        scored = cut(score(docs.select(F.struct("doc_id", "lang", "text").alias("row")), trusted))
    return judge(scored, limits(scored, trusted))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows and columns of ``docs`` whose text is within the limits of its language."""
    trusted = cut(trusted_ids(labels))
    with small_batches(docs.sparkSession):
        scored = cut(score(wrapped(docs), trusted, whole=True))
    return judge(scored, limits(scored.drop("row"), trusted)).where("kept").select("row.*")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
