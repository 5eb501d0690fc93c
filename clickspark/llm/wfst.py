"""SentencePiece encoding and decoding by a weighted finite-state transducer.

A model file is compiled into three parts:

* normaliser: the identity map with a word mark put before the text and in
  place of every space (other character maps are refused);
* pieces: a character trie whose final states emit a piece at a weight, and
  byte fallback: an arc for a character outside the vocabulary that emits its
  UTF-8 bytes' pieces at a high weight;
* order: for merge models a second transducer whose state is the last piece;
  it passes a piece only where merging the two would leave both as they are,
  which of all segmentations admits the one that merging makes.  For unigram
  models it has one state and the weights are the negated scores.

Encoding composes the input with the three and takes the shortest path in the
tropical semiring (a forward pass over (position, state), the least weight over
the arcs that end at each position).  No vocabulary piece continues over a word
mark, so inputs are composed word by word; the new words of a group of texts
are composed in sorted order, so that common beginnings are composed once, and
words' paths are remembered (at most ``limit``).  Decoding runs the pieces
backwards: bytes are gathered, marks become spaces.

Rows: null and empty texts have no ids and decode to the empty text; very
long texts are encoded whole; a word mark in a text decodes to a space;
repeated rows give equal rows; extra columns are ignored; an empty table
gives an empty result."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickspark.llm.common import map_rows, table

MARK = "▁"
MODEL = "piece_bpe_32k.model"
#: Piece and model types of the file format; weight of a fallback character.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, MERGES = 1, 2
FALLBACK = 1e6
_FAR = float("inf")
#: Characters of texts encoded at a time.
GROUP = 1 << 20


def _fields(data: bytes):
    """(number, value) of a serialised message."""
    i = 0

    def number():
        nonlocal i
        value = shift = 0
        while True:
            c = data[i]
            i += 1
            value |= (c & 127) << shift
            shift += 7
            if c < 128:
                return value

    while i < len(data):
        key = number()
        wire = key & 7
        if wire == 0:
            yield key >> 3, number()
            continue
        size = number() if wire == 2 else 8 if wire == 1 else 4
        yield key >> 3, data[i:i + size]
        i += size


class Transducer:
    """A compiled model file."""

    def __init__(self, path: str, limit: int = 600_000):
        with open(path, "rb") as f:
            top = list(_fields(f.read()))
        self.limit, self.known, self.passes = limit, {}, {}
        pieces = [dict(_fields(v)) for k, v in top if k == 1]
        self.text = [p[1].decode() for p in pieces]
        self.score = [struct.unpack("<f", p.get(2, bytes(4)))[0] for p in pieces]
        kinds = [p.get(3, NORMAL) for p in pieces]
        self.kind = next((dict(_fields(v)).get(3, UNIGRAM) for k, v in top if k == 2), UNIGRAM)
        norm = next((dict(_fields(v)) for k, v in top if k == 3), {})
        if norm.get(2) or norm.get(4, 1) or not norm.get(5, 1) or self.kind not in (UNIGRAM, MERGES):
            raise ValueError("only identity normalisers and unigram or merge models are supported")
        self.prefix = MARK if norm.get(3, 1) else ""
        self.byte = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.text, kinds)) if k == BYTE}
        self.unknown = kinds.index(UNKNOWN)
        self.control = {i for i, k in enumerate(kinds) if k in (CONTROL, UNKNOWN)}
        self.ids = {t: i for i, (t, k) in enumerate(zip(self.text, kinds)) if k in (NORMAL, USER)}
        self.rank = {t: self.score[i] for t, i in self.ids.items()}
        # trie of the pieces from their ends: character -> node, None -> the piece that starts here
        self.back: dict = {}
        for t, i in self.ids.items():
            node = self.back
            for c in reversed(t):
                node = node.setdefault(c, {})
            node[None] = i
        self.split = all(MARK not in t.lstrip(MARK) for t in self.ids)
        self.byte_of = {i: b for b, i in self.byte.items()}
        low, high = min(self.byte_of, default=0), max(self.byte_of, default=-1)
        self.byte_range = (low, high)
        self.plain = [("" if i in self.control else t.replace(MARK, " ")) for i, t in enumerate(self.text)]

    # order transducer

    def merged(self, text: str) -> list[str]:
        """What merging makes of a short text: best-scored neighbours first,
        the leftmost of equals."""
        parts, none = list(text), float("-inf")
        rank = [self.rank.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while rank and (best := max(rank)) > none:
            k = rank.index(best)
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
            del rank[k]
            if k:
                rank[k - 1] = self.rank.get(parts[k - 1] + parts[k], none)
            if k < len(rank):
                rank[k] = self.rank.get(parts[k] + parts[k + 1], none)
        return parts

    def passes_pair(self, a: int, b: int) -> bool:
        """Whether piece ``b`` may follow piece ``a``."""
        key = a << 32 | b
        ok = self.passes.get(key)
        if ok is None:
            if len(self.passes) > self.limit:
                self.passes.clear()
            x, y = self.text[a], self.text[b]
            self.passes[key] = ok = self.merged(x + y) == [x, y]
        return ok

    def fallback(self, char: str) -> tuple[int, ...]:
        """The ids of a character outside the vocabulary."""
        if not self.byte:
            return (self.unknown,)
        return tuple(self.byte[b] for b in char.encode("utf-8", "surrogatepass"))

    def paths(self, texts: list[str]):
        """(text, ids on its shortest path) for normalised texts, in sorted
        order.  Tropical semiring: a position's weight is the least over the
        arcs that end there, of the start's weight plus the arc's (one per
        piece for merge models, where the order transducer passes one path;
        the negated score for unigram models).  A position depends on the text
        before it alone, so texts that share a beginning share its positions."""
        ordered, passes, known = self.kind == MERGES, self.passes, self.ids
        last, came, weight, old = [-1], [0], [0.0], ""
        for text in sorted(texts):
            same = 0
            for x, y in zip(text, old):
                if x != y:
                    break
                same += 1
            del last[same + 1:], came[same + 1:], weight[same + 1:]
            old = text
            for j in range(same + 1, len(text) + 1):
                best, piece_at, start = _FAR, -1, -1
                if text[j - 1] not in known:  # byte fallback
                    best, start = weight[j - 1] + FALLBACK, j - 1
                node, i = self.back, j
                while i:
                    i -= 1
                    node = node.get(text[i])
                    if node is None:
                        break
                    piece = node.get(None)
                    if piece is None or came[i] < 0:
                        continue
                    w = weight[i] + (1.0 if ordered else -self.score[piece])
                    if w >= best:
                        continue
                    state = last[i]
                    if ordered and state >= 0:
                        ok = passes.get(state << 32 | piece)
                        if not (self.passes_pair(state, piece) if ok is None else ok):
                            continue
                    best, piece_at, start = w, piece, i
                last.append(piece_at)
                came.append(start)
                weight.append(best)
            out: list[int] = []
            at = len(text)
            while at:
                if last[at] >= 0:
                    out.append(last[at])
                else:
                    out += self.fallback(text[came[at]])[::-1]
                at = came[at]
            yield text, out[::-1]

    def path(self, text: str) -> list[int]:
        """Ids on the shortest path through the composition with ``text``."""
        return next(self.paths([text]))[1]

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of several texts; the words that they add are composed together."""
        parts = [_WORDS.findall(self.prefix + t.replace(" ", MARK)) if t and self.split else
                 [self.prefix + t.replace(" ", MARK)] if t else [] for t in texts]
        known, need = self.known, set().union(*parts)
        new = need.difference(known)
        if len(known) + len(new) > self.limit:
            known.clear()
            new = need
        known.update((p, np.array(ids, "<i4").tobytes()) for p, ids in self.paths(list(new)))
        get = known.__getitem__
        return [np.frombuffer(b"".join(map(get, p)), "<i4") for p in parts]

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text."""
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; runs of byte pieces are decoded together."""
        low, high = self.byte_range
        if ((ids >= low) & (ids <= high)).any():
            out, run = [], bytearray()
            for i in ids.tolist():
                if i in self.byte_of:
                    run.append(self.byte_of[i])
                    continue
                if run:
                    out.append(run.decode("utf-8", "replace"))
                    run.clear()
                out.append(self.plain[i])
            text = "".join(out) + run.decode("utf-8", "replace")
        else:
            text = "".join(map(self.plain.__getitem__, ids.tolist()))
        return text[1:] if self.prefix and text.startswith(" ") else text


_WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_LOADED: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """The worker's own compiled model, loaded once."""
    if path not in _LOADED:
        _LOADED[path] = Transducer(path)
    return _LOADED[path]


def _encoded(t: Transducer, texts: list[str | None]) -> list[np.ndarray]:
    """Ids of the texts of a batch, some at a time."""
    out, at, size = [], 0, 0
    for k, x in enumerate(texts):
        size += len(x or "")
        if size >= GROUP or k + 1 == len(texts):
            out += t.encode_all(texts[at:k + 1])
            at, size = k + 1, 0
    return out


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of piece ids) per document."""

    def run(batches):
        t = transducer(path)
        for b in batches:
            yield {"doc_id": b["doc_id"], "ids": _encoded(t, b["text"])}

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, ids array<int>")


def decode(ids: DataFrame, path: str) -> DataFrame:
    """doc_id, text from (doc_id, ids); null ids give the empty text."""

    def run(batches):
        t = transducer(path)
        for b in batches:
            yield {"doc_id": b["doc_id"], "text": [t.decode(np.array(x or [], "<i4")) for x in b["ids"]]}

    return map_rows(ids.select(F.col("doc_id").cast("long"), "ids"), run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_chars, n_ids, ids, ids_crc32 (unsigned, of
    little-endian 32-bit ids), n_bytes (byte-fallback ids), decoded_chars and
    ``same``: whether decoding the ids gives the text back (a word mark in
    the text stands for a space)."""

    def run(batches):
        t = transducer(path)
        low, high = t.byte_range
        for b in batches:
            ids = _encoded(t, b["text"])
            back = [t.decode(x) for x in ids]
            yield {"doc_id": b["doc_id"], "n_chars": [len(x or "") for x in b["text"]], "n_ids": list(map(len, ids)),
                   "ids": ids, "ids_crc32": [zlib.crc32(x.tobytes()) for x in ids],
                   "n_bytes": [int(((x >= low) & (x <= high)).sum()) for x in ids],
                   "decoded_chars": list(map(len, back)),
                   "same": [(x or "").replace(MARK, " ") == y for x, y in zip(b["text"], back)]}

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), run,
                    "doc_id long, n_chars long, n_ids long, ids array<int>, ids_crc32 long, n_bytes long, "
                    "decoded_chars long, same boolean")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: every document encoded and decoded."""
    import public_tokenizers
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
