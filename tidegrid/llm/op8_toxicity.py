"""Toxic spans by a linear-chain conditional random field over tokens.

Labels are given per document, so tokens are labelled first, on a bounded sample of labelled documents
(``SAMPLE`` of each label, the smallest by a hash of the id, whole texts): a toxic document holds at least one
toxic token. Tokens ``ODDS`` times more frequent in toxic than in clean documents, beyond a chance of ``CHANCE``
over all kinds of tokens, are labelled toxic in toxic documents, all others clean. A token's frequency is
its number of documents, or of different neighbours if these are fewer, so that copies of one document
don't add up. Toxic documents without such a token teach nothing.

The field has two states, weights for each token, its beginnings of ``HEADS`` bytes (inflected forms share them)
and its two neighbours, and transitions. It starts from the
tokens' own log-odds and is fitted by regularised gradient steps on its log-likelihood; the gradient comes
from forward-backward marginals. Scoring reads whole texts of all documents in their partitions, with no shuffle: a token's
score is its marginal of being toxic, a document's is the chance that at least one token is, and runs of
tokens with a marginal of 0.5 or more are the offending spans, in bytes of the UTF-8 text.

Tokens are runs of bytes other than ASCII signs and white space, without case. Null and empty texts have
no tokens and score 0. Labels that are null teach nothing; ids that have several labelled rows take
the largest label. Rows repeat as they come; extra columns are ignored. Without toxic labels every score is near 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegrid.llm.common import BASE, fold, fold_of, mixed, runs, slices, table, texts_of, tidy
from tidegrid.session import cut

SAMPLE = 2_000
ODDS, CHANCE = 10.0, 0.01
EPOCHS, RATE, DECAY = 8, 0.05, 2e-6
WINDOW = 256
CELLS = 1 << 18
HEADS, FORMS = (4, 5, 6), 4
APART = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])


def tokens(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Of every token the hashes of itself and its beginnings, the row, begin and end (bytes within the row); the number of rows."""
    body, starts = texts_of(column)
    begin, end, h, row, *heads = runs(body, starts, APART, HEADS)
    return np.stack([h, *heads]), row, begin - starts[row], end - starts[row], len(starts) - 1


def _support(at: np.ndarray, mark: np.ndarray, kinds: int) -> np.ndarray:
    """How many different marks each kind has."""
    _, first = np.unique(mixed(mark + at.astype(np.uint64) * np.uint64(BASE)), return_index=True)
    return np.bincount(at[first], minlength=kinds)


def lexicon(h: np.ndarray, row: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of tokens and of beginnings that are significantly and ``ODDS`` times more frequent in toxic rows."""
    around = mixed(np.roll(h[0], 1) * np.uint64(3) + np.roll(h[0], -1))
    p, n = max(toxic.sum(), 1), max((~toxic).sum(), 1)

    def telling(own: np.ndarray, forms: int) -> np.ndarray:
        real = own > 0
        kinds, at = np.unique(own[real], return_inverse=True)
        hot, near, rows, whole = toxic[row[real]], around[real], row[real].astype(np.uint64), h[0][real]
        pos, neg = (np.minimum(_support(at[m], near[m], len(kinds)), _support(at[m], rows[m], len(kinds))) for m in (hot, ~hot))
        due = (pos + neg) * p / (p + n)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(pos > 0, pos * np.log(pos / due), 0) + np.where(neg > 0, neg * np.log(neg / (pos + neg - due)), 0)
        odds = (pos + 0.5) / (p + 1) / ((neg + 0.5) / (n + 1))
        found = (odds >= ODDS) & (gain > np.log(max(len(kinds), 1) / CHANCE))
        if forms > 1:
            found &= _support(at[hot], whole[hot], len(kinds)) >= forms
        return kinds[found]

    # A beginning counts only if it is that of several toxic forms; else the token itself says it.
    return telling(h[0], 1), np.unique(np.concatenate([telling(own, FORMS) for own in h[1:]] or [h[0][:0]]))


class Field:
    """Weights of the toxic state against the clean one, by token, beginning and neighbour, and transitions.

    ``kinds``: hashes of tokens and beginnings, ascending; ``weights``: of each, and a last row of
    zeros for unknown ones: as itself, as the token before, as the token after.
    """

    def __init__(self, kinds: np.ndarray, weights: np.ndarray, bias: float, moves: np.ndarray):
        self.kinds, self.weights, self.bias, self.moves = kinds, weights, bias, moves

    def place(self, h: np.ndarray) -> np.ndarray:
        """Row of ``weights`` of each hash."""
        if not len(self.kinds):
            return np.zeros(h.shape, np.int64)
        at = np.minimum(np.searchsorted(self.kinds, h), len(self.kinds) - 1)
        return np.where(self.kinds[at] == h, at, len(self.kinds))

    def emit(self, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Toxic against clean, of each token; ``first`` and ``last`` mark ends of rows."""
        own, before, after = (self.weights[:, i][at].sum(0) for i in range(3))
        return own + self.bias + np.where(first, 0, np.roll(before, 1)) + np.where(last, 0, np.roll(after, -1))


def marginals(score: np.ndarray, lengths: np.ndarray, moves: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Chance of the toxic state at each token of many chains end to end, and expected transitions if asked for.

    Chains of similar length go together, a step at a time over all of them. With two states the forward
    and backward messages are one number each: toxic over clean.
    """
    out, moved = np.zeros(len(score)), np.zeros((2, 2))
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    (a, b), (c, d) = np.exp(moves)  # from clean, from toxic
    at = 0
    while at < len(order):
        t = int(lengths[order[at]])
        part = order[at : at + max(64, CELLS // t)]
        at += len(part)
        size = lengths[part]
        live = np.arange(t)[:, None] < size[None, :]
        where = (starts[part][None, :] + np.arange(t)[:, None])[live]
        e = np.ones((t, len(part)))
        e[live] = np.exp(np.clip(score[where], -30, 30))
        ahead, back = e.copy(), np.ones_like(e)
        for i in range(1, t):
            r = ahead[i - 1]
            ahead[i] *= (b + d * r) / (a + c * r)
        ends = np.searchsorted(-size, -np.arange(1, t + 1), "right")  # how many chains reach each step
        for i in range(t - 1, 0, -1):
            n = ends[i]
            x = e[i, :n] * back[i, :n]
            back[i - 1, :n] = (c + d * x) / (a + b * x)
        both = ahead * back
        out[where] = (both / (1 + both))[live]
        if pairs and t > 1:
            r, x, on = ahead[:-1], e[1:] * back[1:], live[1:]
            w = np.stack([np.full_like(r, a), b * x, c * r, d * r * x])
            moved += ((w / w.sum(0)) * on).sum((1, 2)).reshape(2, 2)
    return out, moved


def fit(h: np.ndarray, row: np.ndarray, toxic: np.ndarray, epochs: int = EPOCHS) -> Field:
    """The field of labelled documents: ``toxic`` per row."""
    whole, heads = lexicon(h, row, toxic)
    h = np.vstack([h[:1], np.where(np.isin(h[1:], heads), h[1:], np.uint64(0))])
    marked = np.isin(h[0], whole) | (h[1:] > 0).any(0)
    explained = np.zeros(len(toxic), bool)
    explained[row[marked]] = True
    use = ~toxic[row] | explained[row]
    h, row, y = h[:, use], row[use], (marked & toxic[row])[use]
    seen, n = np.unique(h[h > 0], return_counts=True)
    field = Field(seen[n >= 2], np.zeros(((n >= 2).sum() + 1, 3)), 0.0, np.zeros((2, 2)))
    if not y.any():
        field.bias = -12.0
        return field
    # Chains of at most WINDOW tokens of one document.
    since = np.arange(len(row)) - np.searchsorted(row, row)
    first = np.concatenate([[True], np.diff(row) != 0]) | (since % WINDOW == 0)
    lengths = np.diff(np.concatenate([np.flatnonzero(first), [len(row)]]))
    last = np.concatenate([first[1:], [True]])
    at = field.place(h)
    inner = np.flatnonzero(~first)
    real = np.zeros((2, 2))
    np.add.at(real, (y[inner - 1].astype(int), y[inner].astype(int)), 1)
    size = len(field.weights)
    # A token seen once is never labelled toxic, so what is unknown starts below one in so many.
    field.bias = -float(np.log(2 * max((n < 2).sum(), 1000)))
    total = lambda of: sum(np.bincount(own, of, size) for own in at)
    hot, every = total(y), total(np.ones(len(y)))
    # Its log-odds against the bias, shared among a token and its beginnings.
    field.weights[:, 0] = (np.clip(np.log((hot + np.exp(field.bias)) / (every - hot + 1)), -20, 20) - field.bias) / np.maximum(total((h > 0).sum(0)) / np.maximum(every, 1), 1)
    field.weights[-1] = 0
    squares, bias_square, move_square = np.full(field.weights.shape, 1e-2), 1e-2, np.full((2, 2), 1e-2)
    for _ in range(epochs):
        p, pairs = marginals(field.emit(at, first, last), lengths, field.moves, True)
        miss = y - p
        grad = np.stack([total(miss), total(np.where(last, 0, np.roll(miss, -1))), total(np.where(first, 0, np.roll(miss, 1)))], 1)
        grad[-1] = 0
        grad -= DECAY * len(y) * field.weights
        move = real - pairs
        squares += grad**2
        bias_square += miss.sum() ** 2
        move_square += move**2
        field.weights += RATE * grad / np.sqrt(squares)
        field.bias += RATE * miss.sum() / np.sqrt(bias_square)
        field.moves += RATE * move / np.sqrt(move_square)
    return field


def lighten(field: Field, h: np.ndarray) -> Field:
    """Without the kinds that leave a token as clean as an unknown one: those that speak for toxic stay, and tokens that share one's beginning."""
    for_toxic = field.kinds[field.weights[:-1].max(1, initial=0) > 0.5]
    kept = np.unique(np.concatenate([for_toxic, h[:, np.isin(h, for_toxic).any(0)].ravel()]))
    stay = np.isin(field.kinds, kept)
    return Field(field.kinds[stay], np.vstack([field.weights[:-1][stay], field.weights[-1:]]), field.bias, field.moves)


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most ``size`` labelled documents of each label whose id isn't held out."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(fold(F.col("doc_id")) != 0)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    # At most 2 * size ids, whatever the number of labels.
    chosen = cut(known.where("toxic = 1").orderBy(order).limit(size).unionByName(known.where("toxic = 0").orderBy(order).limit(size)))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select("text", "toxic")


def learn(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Field:
    """Fits the field in one task, on the bounded sample."""
    def run(batches: Iterator[pa.RecordBatch]):
        h, row, toxic, rows = [], [], [], 0
        for batch in slices(batches, "text"):
            found, own, _, _, n = tokens(batch["text"])
            h.append(found), row.append(own + rows), toxic.append(batch["toxic"].to_numpy(zero_copy_only=False) == 1)
            rows += n
        if rows:
            whole = np.concatenate(h, axis=1)
            h.clear()
            field = lighten(fit(whole, np.concatenate(row), np.concatenate(toxic)), whole)
            yield pa.RecordBatch.from_pydict({"kinds": [field.kinds.tobytes()], "weights": [field.weights.astype(np.float32).tobytes()], "bias": [float(field.bias)], "moves": [field.moves.tobytes()]})

    found = sample(docs, labels, size).coalesce(1).mapInArrow(tidy(run), "kinds binary, weights binary, bias double, moves binary").first()
    if found is None:
        return Field(np.zeros(0, np.uint64), np.zeros((1, 3)), -12.0, np.zeros((2, 2)))
    return Field(np.frombuffer(found["kinds"], np.uint64), np.frombuffer(found["weights"], np.float32).reshape(-1, 3).astype(float), found["bias"], np.frombuffer(found["moves"]).reshape(2, 2))


def tag(field: Field, column) -> tuple[np.ndarray, list[list[dict]]]:
    """A score and the offending spans of every row."""
    h, row, begin, end, n = tokens(column)
    lengths = np.bincount(row, minlength=n)
    first, last = np.zeros(len(row), bool), np.zeros(len(row), bool)
    ends = np.cumsum(lengths)[lengths > 0]
    last[ends - 1] = True
    first[ends - lengths[lengths > 0]] = True
    p, _ = marginals(field.emit(field.place(h), first, last), lengths, field.moves)
    none = np.bincount(row, np.log1p(-np.minimum(p, 1 - 1e-12)), n)
    spans: list[list[dict]] = [[] for _ in range(n)]
    for i in np.flatnonzero(p >= 0.5):
        own = spans[row[i]]
        if i and not first[i] and p[i - 1] >= 0.5:
            own[-1]["end"] = int(end[i])
        else:
            own.append({"begin": int(begin[i]), "end": int(end[i])})
    return -np.expm1(none), spans


SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def classify(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        for batch in slices(batches, "text"):
            score, spans = tag(shared.value, batch["text"])
            held = [fold_of(i) == 0 for i in batch["doc_id"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(held), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(spans, SPANS)],
                                             ["doc_id", "held_out", "score", "predicted", "spans"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id bigint, held_out boolean, score double, predicted int, spans array<struct<begin: bigint, end: bigint>>")


def keep_clean(docs: DataFrame, field: Field) -> DataFrame:
    """The rows and columns of ``docs`` that are not toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        for batch in slices(batches, "text"):
            yield batch.filter(pa.array(tag(shared.value, batch["text"])[0] < 0.5))

    return docs.mapInArrow(tidy(run), docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, learn(docs, table(spark, sf_dir, "labels")))
