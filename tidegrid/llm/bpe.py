"""Byte-level BPE: pieces by pattern, a bounded-lookahead streaming encoder, an incremental decoder.

The encoder reads a text in chunks and holds back only what later input could still change. Between
pieces that is the last match of the pattern; inside a piece longer than its window it is the merge
list's sufficient lookahead, which ``MergeList.lookahead`` computes. Its memory is one chunk, one
window and a cache of pieces of fixed size, whatever the length of the text.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
from array import array

import regex

VOCABULARY = "byte_bpe_50k.json"
# Fixed value: the pattern of the vocabulary's byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same over ASCII and Latin-1 letters, where the standard matcher agrees and is twice as fast.
_L = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
_NARROW = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[0-9]+| ?[^\t-\r {_L}0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
_WIDE = regex.compile(PATTERN)
_OUTSIDE = re.compile(rf"[^\t-\r -~{_L}]")
CACHED = 400_000
_NEVER = 1 << 62


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def pieces(text: str) -> list[str]:
    return (_NARROW if _OUTSIDE.search(text) is None else _WIDE).findall(text)


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class MergeList:
    """Merges by rank over token ids, the bytes of each token, and the special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        chars = byte_chars()
        back = {c: b for b, c in chars.items()}
        vocab = spec["model"]["vocab"]
        self.start = [vocab[chars[b]] for b in range(256)]
        self.bytes_of = {i: bytes(back[c] for c in t) for t, i in vocab.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((vocab[left], vocab[right]), (rank, vocab[left + right]))
        self.coded = {pair: rank << 20 | made for pair, (rank, made) in self.merges.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.lookahead = self._lookahead()
        self.window = 4 * self.lookahead

    def _lookahead(self) -> int:
        """Bytes after a token that can still change whether it stands: an upper bound.

        A token t is lost only if a rule (t, y) takes it, and whether y is there depends on y itself
        or a token s on y's right edge being taken by a rule of a smaller rank. Ranks fall along such
        a chain, so one pass in rank order gives the furthest reach from the start of every token.
        """
        size = {t: len(b) for t, b in self.bytes_of.items()}
        parts: dict[int, tuple[int, int]] = {}
        reach: dict[int, int] = {}
        for (left, right), (_, made) in sorted(self.merges.items(), key=lambda m: m[1][0]):
            far, s = size[right], right
            while True:
                far = max(far, size[right] - size[s] + reach.get(s, size[s]))
                if s not in parts:
                    break
                s = parts[s][1]
            reach[left] = max(reach.get(left, 0), size[left] + far)
            parts.setdefault(made, (left, right))
        # The same for a token made to the left of the cut: its right edge may be taken before it forms.
        return max([*reach.values(), *size.values()])

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a short run of bytes: the lowest rank first, the leftmost among equals."""
        ids = [self.start[b] for b in piece]
        if len(ids) > 48:
            return self._merge_long(ids)
        get = self.coded.get
        costs = [get(pair, _NEVER) for pair in zip(ids, ids[1:])]
        while costs and (best := min(costs)) != _NEVER:
            i = costs.index(best)
            ids[i : i + 2] = [best & 0xFFFFF]
            del costs[i]
            if i < len(costs):
                costs[i] = get((ids[i], ids[i + 1]), _NEVER)
            if i:
                costs[i - 1] = get((ids[i - 1], ids[i]), _NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        merges, n = self.merges, len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, left, right, made = heapq.heappop(heap)
            j = after[i] if ids[i] == left else -1
            if j < 0 or ids[j] != right:
                continue
            ids[i], ids[j], after[i] = made, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
                if m := merges.get((made, ids[after[i]])):
                    heapq.heappush(heap, (m[0], i, made, ids[after[i]], m[1]))
            if before[i] >= 0 and (m := merges.get((ids[before[i]], made))):
                heapq.heappush(heap, (m[0], before[i], ids[before[i]], made, m[1]))
        return [t for t in ids if t >= 0]

    def stable(self, piece: bytes) -> tuple[list[int], bytes]:
        """The ids that no later bytes can change, and the bytes after them (a window at most)."""
        out, at = [], 0
        while len(piece) - at > self.window:
            end = at
            for token in self.merge(piece[at : at + self.window]):
                end += len(self.bytes_of[token])
                if end > at + self.window - self.lookahead:
                    end -= len(self.bytes_of[token])
                    break
                out.append(token)
            at = end
        return out, piece[at:]


class Pieces(dict):
    """Ids of each piece as little-endian 32-bit bytes, made when first asked for.

    Two generations of ``CACHED`` pieces bound its memory: what is used again moves to the newer one.
    """

    def __init__(self):
        super().__init__()
        self.older: dict[str, bytes] = {}

    def make(self, piece: str) -> bytes:
        raise NotImplementedError

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece) or self.make(piece)
        if len(piece) <= 64:
            if len(self) >= CACHED:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Ids(Pieces):
    """By the merge list."""

    def __init__(self, merges: MergeList):
        super().__init__()
        self.merges = merges

    def make(self, piece: str) -> bytes:
        ids, rest = self.merges.stable(piece.encode())
        return array("I", ids + self.merges.merge(rest)).tobytes()


class StreamingEncoder:
    """``push`` gives the ids that no later chunk can change, ``finish`` the rest."""

    def __init__(self, merges: MergeList, ids: Ids | None = None):
        self.merges, self.ids = merges, ids if ids is not None else Ids(merges)
        self.held = ""  # what later input may still split differently
        self.run: regex.Pattern | None = None  # the class of the endless piece that is open
        self.pending = b""  # bytes of that piece that are not stable yet
        self.specials = re.compile("|".join(map(re.escape, sorted(merges.special, key=len, reverse=True))) or r"(?!)")
        self.prefixes = tuple({s[:n] for s in merges.special for n in range(1, len(s))})

    def push(self, chunk: str) -> bytes:
        self.held += chunk
        out = []
        while found := self.specials.search(self.held):
            rest = self.held[found.end() :]
            self.held = self.held[: found.start()]
            out += [self._flush(), array("I", [self.merges.special[found[0]]]).tobytes()]
            self.held = rest
        tail = ""
        if self.held.endswith(self.prefixes):  # perhaps the start of a special string
            n = max(len(x) for x in self.prefixes if self.held.endswith(x))
            self.held, tail = self.held[:-n], self.held[-n:]
        out.append(self._advance())
        self.held += tail
        return b"".join(out)

    def finish(self) -> bytes:
        return self._flush()

    def _advance(self) -> bytes:
        out = []
        if self.run is not None:
            more = self.run.match(self.held).end()
            # White space gives its last character to a word that follows.
            more -= self.run is _RUNS[3] and more > 0
            self.pending += self.held[:more].encode()
            self.held = self.held[more:]
            out.append(self._stable())
            if len(self.held) <= (self.run is _RUNS[3]):
                return b"".join(out)
            out.append(self._close())
        found = pieces(self.held)
        # The last match may grow, and a quote before it may turn out to be a contraction.
        if len(found) > 2:
            out.append(b"".join(map(self.ids.__getitem__, found[:-2])))
            found = found[-2:]
        if found and len(found[-1]) > self.merges.window:
            out.append(b"".join(map(self.ids.__getitem__, found[:-1])))
            body = found[-1]
            self.run = next(r for r in _RUNS if r.match(body[-1:]).end())
            keep = len(body) - (self.run is _RUNS[3])
            self.pending, found = body[:keep].encode(), [body[keep:]]
            out.append(self._stable())
        self.held = "".join(found)
        return b"".join(out)

    def _flush(self) -> bytes:
        out = [self._advance()] if self.run is not None else []
        if self.run is not None:
            self.pending, self.held = self.pending + self.held.encode(), ""
            out.append(self._close())
        out.append(b"".join(map(self.ids.__getitem__, pieces(self.held))))
        self.held = ""
        return b"".join(out)

    def _stable(self) -> bytes:
        ids, self.pending = self.merges.stable(self.pending)
        return array("I", ids).tobytes()

    def _close(self) -> bytes:
        ids, self.pending, self.run = self.merges.merge(self.pending), b"", None
        return array("I", ids).tobytes()


# The classes that the pattern repeats without end: letters, digits, other signs, white space.
_RUNS = tuple(regex.compile(x) for x in (r"\p{L}*", r"\p{N}*", r"[^\s\p{L}\p{N}]*", r"\s*"))


class Decoder:
    """Byte-to-text state machine: tokens may end inside a character; what is no UTF-8 becomes U+FFFD."""

    def __init__(self, merges: MergeList):
        self.bytes_of = merges.bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids) -> str:
        return self.state.decode(b"".join(map(self.bytes_of.__getitem__, ids)))

    def finish(self) -> str:
        return self.state.decode(b"", True)


_LOADED: dict[str, tuple] = {}


def own(path: str) -> tuple[MergeList, Ids]:
    """The merge list and piece cache of this worker."""
    if ("own", path) not in _LOADED:
        merges = MergeList(path)
        _LOADED["own", path] = merges, Ids(merges)
    return _LOADED["own", path]


class Library:
    """Ids by the tokenizers library, which splits at the same pieces: each piece is encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.known = _Known(self.tokenizer)

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a whole text."""
        if _OUTSIDE.search(text) is None and not any(s in text for s in self.special):
            return b"".join(map(self.known.__getitem__, _NARROW.findall(text)))
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


class _Known(Pieces):
    """By the library's model, which takes a piece as the characters that stand for its bytes."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer
        self.model = tokenizer.model
        chars = byte_chars()
        self.shown = {c: "".join(chars[b] for b in chr(c).encode()) for c in range(256)}

    def make(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(piece.translate(self.shown))]).tobytes()


def library(path: str) -> Library:
    """The tokenizer and piece cache of this worker."""
    if ("library", path) not in _LOADED:
        _LOADED["library", path] = Library(path)
    return _LOADED["library", path]
