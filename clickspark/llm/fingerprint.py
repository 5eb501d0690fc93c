"""Document fingerprints from prefix polynomial hashes.

For a text with code points c_i the prefix arrays hold the sums of
(c_i + 1) B^i modulo 2^31 - 1.  The difference of two entries, shifted back
by a power of B, is the hash of that span wherever it stands, so any two
spans are compared in constant time (two bases, 62 bits) and the longest
common extension of two positions is found by binary search.

A fingerprint is the hash of the whole text, its length and a sketch per span
length of ``SPANS``: the smallest mixed hashes of all spans of so many code
points.  The likeness of two fingerprints estimates, from the overlap of their
sketches of one span length, the share of spans that the two texts have in
common (2 J / (1 + J) for Jaccard J), and is 1 for equal fingerprints; the long
spans decide, the short ones weigh in the more the shorter a text is.

Rows: null texts are empty; the empty text has an empty sketch and is like
another empty text only; a text shorter than a span is one span; very long
texts are hashed whole; documents are ordered by doc_id (nulls first), rows
of one doc_id by the hash of their text; a single document follows itself;
extra columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickspark.llm.common import map_rows, table
from clickspark.staging import stage_table

P = (1 << 31) - 1
BASES = (1_103_515_245, 1_664_525_081)
#: Lengths of the sketched spans and the sizes of their sketches.
SPANS = ((12, 48), (3, 24))

_POWERS: dict[int, np.ndarray] = {}


def _reduce(x: np.ndarray) -> np.ndarray:
    """Modulo 2^31 - 1 of values below 2^62 (P itself may remain)."""
    p = np.uint64(P)
    x = (x & p) + (x >> np.uint64(31))
    return (x & p) + (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) mod P, kept and grown by doubling."""
    p = _POWERS.get(base, np.ones(1, np.uint64))
    while len(p) < n:
        step = np.uint64(pow(base, len(p), P))
        p = np.concatenate([p, _reduce(p * step)])
    _POWERS[base] = p
    return p[:n]


class PrefixHashes:
    """Prefix arrays of a text, one per base."""

    def __init__(self, text: str):
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        self.n = len(self.codes)
        self._prefix: dict[int, np.ndarray] = {}

    def prefix(self, base: int) -> np.ndarray:
        if base not in self._prefix:
            terms = _reduce(self.codes * _powers(base, self.n))
            out = np.zeros(self.n + 1, np.uint64)
            np.cumsum(terms, out=out[1:])
            self._prefix[base] = _reduce(out)
        return self._prefix[base]

    def spans(self, length: int, base: int) -> np.ndarray:
        """Hashes of all spans of ``length``, position-free."""
        pre = self.prefix(base)
        back = _powers(pow(base, -1, P), self.n - length + 1)
        h = _reduce((pre[length:] + np.uint64(2 * P) - pre[:self.n - length + 1]) % np.uint64(P) * back)
        return np.where(h == np.uint64(P), np.uint64(0), h)

    def span(self, start: int, length: int) -> tuple[int, int]:
        """Hash of one span under both bases."""
        out = []
        for base in BASES:
            pre = self.prefix(base)
            d = (int(pre[start + length]) - int(pre[start])) % P
            out.append(d * pow(base, -start, P) % P)
        return out[0], out[1]

    def lce(self, other: PrefixHashes, i: int = 0, j: int = 0) -> int:
        """Longest common extension of position i here and j there."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            if self.span(i, mid) == other.span(j, mid):
                low = mid
            else:
                high = mid - 1
        return low

    def whole(self) -> tuple[int, int]:
        a = int(self.prefix(BASES[0])[self.n]) % P
        b = int(_reduce(self.codes * _powers(BASES[1], self.n)).sum()) % P
        return a, b

    def sketch(self, span: int, size: int) -> np.ndarray:
        """The least ``size`` mixed hashes of the text's spans of a length (of
        the text itself where it is shorter)."""
        h = self.spans(min(span, self.n), BASES[0])
        mixed = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
        low = mixed
        if self.n > 8 * size:  # most spans lie above any value that can be kept
            low = mixed[mixed < (4 * size * 2 ** 32) // len(mixed)]
        low = np.unique(low)
        if len(low) < size:
            low = np.unique(mixed)
        return low[:size]

    def fingerprint(self, spans=SPANS) -> str:
        """Whole-text hash, length, and one sketch per span length, in hex."""
        head = "{:08x}{:08x}:{:x}".format(*self.whole(), self.n)
        sketches = [self.sketch(k, size).astype(">u4").tobytes().hex() if self.n else "" for k, size in spans]
        return ":".join([head, *sketches])


def likeness(a: str, b: str, spans=SPANS) -> float:
    """Share of common spans of two fingerprints' texts, 0 to 1: that of the
    long spans, and of the short ones by the weight long / (length of the
    shorter text), 1 at most.  Sketches of one span length are compared with
    each other alone, and the weight has no steps."""
    if a == b:
        return 1.0
    x, y = a.split(":"), b.split(":")
    n = min(int(x[1], 16), int(y[1], 16))
    if not n:
        return 0.0
    long, short = (_common(p, q, size) for p, q, (_, size) in zip(x[2:], y[2:], spans))
    w = min(1.0, spans[0][0] / n)
    return w * short + (1 - w) * long


def _common(a: str, b: str, size: int) -> float:
    """Dice share of the span sets behind two sketches."""
    x, y = (np.frombuffer(bytes.fromhex(f), ">u4") for f in (a, b))
    union = np.union1d(x, y)
    if len(x) >= size or len(y) >= size:  # beyond the larger kept value of a full sketch nothing is known
        union = union[:size]
    both = np.intersect1d(np.intersect1d(x, y), union)
    j = len(both) / len(union)
    return 2 * j / (1 + j)


_FIELDS = ("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
           "near_next double, shared_prefix long")
_NAMES = [f.split()[0] for f in _FIELDS.split(", ")]


def _compared(text: str, own: tuple[PrefixHashes, str], next_text: str, next_print: str) -> tuple:
    """The figures of one document and the one after it."""
    hashes, fp = own
    m = hashes.n // 4
    edited = text[:hashes.n - m] + next_text[:m]
    changed = PrefixHashes(edited)
    efp = changed.fingerprint()
    return (hashes.n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), fp, efp,
            likeness(fp, efp), likeness(fp, next_print), hashes.lce(changed))


def _printed(text: str) -> tuple[PrefixHashes, str]:
    h = PrefixHashes(text)
    return h, h.fingerprint()


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, shared_prefix (longest common
    extension of the text and its edited text at their starts)."""
    names = ["kind", "pid", "doc_id", "text", *_NAMES]

    def run(batches):
        pid, held, first = TaskContext.get().partitionId(), None, True
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"]):
                text = text or ""
                if first:
                    rows.append((1, pid, doc_id, text, *[None] * len(_NAMES)))
                    first = False
                own = _printed(text)
                if held:
                    rows.append((0, pid, held[0], None, *_compared(held[1], held[2], text, own[1])))
                held = (doc_id, text, own)
            yield dict(zip(names, zip(*rows))) if rows else {n: [] for n in names}
        if held:
            yield dict(zip(names, ([x] for x in (2, pid, held[0], held[1], *[None] * len(_NAMES)))))

    order = (F.col("doc_id").asc_nulls_first(), F.col("th"))
    d = docs.select(F.col("doc_id").cast("long"), "text").withColumn("th", F.xxhash64("text"))
    ranged = d.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    made = stage_table(map_rows(ranged, run, f"kind int, pid int, doc_id long, text string, {_FIELDS}"))
    inner = made.where("kind = 0").select("doc_id", *_NAMES)
    # one document per task is left, whose next is the first of the next task that has any
    firsts = made.where("kind = 1").select("pid", F.col("text").alias("next_text"))
    ring = firsts.select("pid", F.coalesce(F.lead("pid").over(Window.orderBy("pid")),
                                           F.min("pid").over(Window.partitionBy())).alias("after"))
    lasts = (made.where("kind = 2").select("pid", "doc_id", "text").join(ring, "pid")
             .join(firsts.withColumnRenamed("pid", "after"), "after").select("doc_id", "text", "next_text"))

    def close(batches):
        for b in batches:
            rows = [(d, *_compared(t, _printed(t), n, _printed(n)[1]))
                    for d, t, n in zip(b["doc_id"], b["text"], b["next_text"])]
            yield dict(zip(["doc_id", *_NAMES], zip(*rows))) if rows else {k: [] for k in ["doc_id", *_NAMES]}

    return inner.unionByName(map_rows(lasts, close, f"doc_id long, {_FIELDS}"))


def query(spark, sf_dir: str) -> DataFrame:
    """op6: contract columns (and shared_prefix) over all documents."""
    return fingerprints(table(spark, sf_dir, "documents"))
