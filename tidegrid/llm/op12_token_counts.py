"""Token counts by a whole-token shortcut.

A sentencepiece BPE model never merges over a border that no piece of its vocabulary spans. Where no piece has
the blank sign after another character, every text falls into units: blanks and what follows up to the next
blank. ``prove`` encodes every vocabulary string that looks like such a unit once, before any text is read,
and keeps those that come out as exactly one token. A text's units are then looked up in that set and counted
directly; only the others are merged by the library, side by side in one call, as nothing joins them either. A
model with a piece that spans borders, or with a normalizer of its own, has no units: then the library
encodes whole texts.

The proven set is broadcast: it is bounded by the vocabulary. Long texts advance in pieces cut at unit borders.
Null and empty texts have no tokens. A null doc_id stays. Repeated rows count each. Extra columns are ignored.
An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, functions as F
from sentencepiece import sentencepiece_model_pb2

from tidegrid.llm.common import slices, table

MODEL, LIMIT = "piece_bpe_32k.model", 4096
BLANK = "▁"
UNIT, BORDER = re.compile(f"{BLANK}+[^{BLANK}]*"), re.compile(f"(?<=[^{BLANK}]){BLANK}")
BREAK = re.compile(f"[^ {BLANK}](?=[ {BLANK}])")
PIECE = 1 << 18
NORMAL = 1  # a piece's type in the model's format
_MODELS: dict[str, sentencepiece.SentencePieceProcessor] = {}


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(MODEL))


def model(path: str) -> sentencepiece.SentencePieceProcessor:
    if path not in _MODELS:
        _MODELS[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _MODELS[path]


def prove(path: str) -> frozenset[str] | None:
    """The vocabulary's units that encode alone as one token; None if texts don't fall into units.

    The library puts one blank before a text, so a unit is encoded without its first blank. The lone blank
    can't be encoded that way; being a single character it merges with nothing.
    """
    spec = sentencepiece_model_pb2.ModelProto.FromString(model(path).serialized_model_proto())
    form = spec.normalizer_spec
    plain = form.name == "identity" and not form.precompiled_charsmap and form.add_dummy_prefix and not form.remove_extra_whitespaces and form.escape_whitespaces
    pieces = [(i, p.piece) for i, p in enumerate(spec.pieces) if p.type == NORMAL]
    whole = not any(p.type not in (1, 2, 3, 6) for p in spec.pieces) and spec.trainer_spec.byte_fallback and not spec.trainer_spec.treat_whitespace_as_suffix
    if not plain or not whole or not any(p == BLANK for _, p in pieces) or any(BORDER.search(p) for _, p in pieces):
        return None
    units = [(i, p) for i, p in pieces if p.startswith(BLANK) and p != BLANK]
    ids = model(path).encode([p[1:] for _, p in units], num_threads=1)
    return frozenset([BLANK, *(p for (i, p), found in zip(units, ids) if found == [i])])


def units(text: str) -> Iterator[list[str]]:
    """A text's units, in pieces of about ``PIECE`` characters; one unit may be longer."""
    at, n = 0, len(text)
    while at < n:
        end = n
        if n - at > PIECE:
            border = BREAK.search(text, at + PIECE)
            end = border.start() + 1 if border else n
        part = text[at:end].replace(" ", BLANK)
        yield UNIT.findall(part if at else BLANK + part)
        at = end


class Counter:
    """Counts tokens: one for each proven unit; all others of a piece go to the library in one call, as no merge joins them."""

    def __init__(self, path: str, proven: frozenset[str] | None):
        self.model, self.proven = model(path), proven

    def count(self, text: str) -> int:
        if self.proven is None:
            return len(self.model.encode(text, num_threads=1))
        total = 0
        for part in units(text):
            rest = [*itertools.filterfalse(self.proven.__contains__, part)]
            total += len(part) - len(rest)
            if rest:
                total += len(self.model.encode("".join(rest)[1:], num_threads=1))
        return total


def count_tokens(docs: DataFrame, limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document."""
    path = path or default_path()
    shared = docs.sparkSession.sparkContext.broadcast(prove(path))

    def run(batches):
        counter = Counter(path, shared.value)
        for batch in slices(batches, "text"):
            text = batch["text"]
            counts = [counter.count(t.as_py() or "") for t in text]
            size = pc.fill_null(pc.binary_length(text).cast(pa.int64()), 0)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], size, pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
