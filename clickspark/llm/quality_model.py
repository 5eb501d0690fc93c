"""Quality classifier without gold labels.

1. Overlapping heuristic labellers vote good, bad or nothing on every
   document (one scan; the votes are counted by pattern, at most 3^9 rows).
2. Expectation-maximisation over the pattern counts estimates each
   labeller's vote probabilities in both classes and the class share; the
   posterior of a document is that of its pattern.
3. A hashed linear scorer (logistic regression over hashed word shapes and
   shape pairs) is trained on posteriors of a bounded sample (``TRAIN_DOCS``
   different documents, the first by hash) and scores every document.

The driver holds pattern counts, the sample's sparse features and the
weights.  Null and empty texts get no votes and the prior's posterior; their
score is the scorer's intercept, and they are kept.  Very long texts are read
whole; repeated rows score alike (all count in EM); extra columns are
ignored; an empty table gives an empty result and an untrained model."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickspark.llm.common import DOCUMENT_COLUMNS, DOCUMENTS, logistic, map_rows, table
from clickspark.staging import stage_table

#: Different documents that the scorer is trained on, the first by hash.
TRAIN_DOCS = 20_000
#: Hash buckets of the scorer; documents scoring below the threshold go.
BUCKETS, THRESHOLD = 1 << 12, 0.5
#: Labellers of a defect vote bad or are silent; the others may vote good.
DEFECTS = ("symbols", "shouting", "separators", "stutter", "decorated", "characters")
LABELLERS = (*DEFECTS, "variety", "stops", "word_length")
#: Shorter texts get no votes.
MIN_WORDS = 10

_KEEP_SYMBOLS = bytes(b for b in range(256) if b not in b"#*$%&|<>{}\\^~")
_ASCII_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_ALNUM = bytes(b for b in range(256) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128))
_DECORATIONS = [bytes((c, c, 32)) for c in b"#*$%&|<>!~^=_"]
_SEPARATORS = frozenset((b"|", b">", b"<", b"/", b"\xc2\xbb", b"\xe2\x80\xa2", b"-", b"*", b"\xc2\xb7"))


def _vote(x: float, fine: tuple[float, float], good: tuple[float, float] | None = None) -> int:
    """2 (bad) outside ``fine``, 1 (good) inside ``good``, else 0 (no vote)."""
    return 2 if not fine[0] <= x <= fine[1] else 1 if good and good[0] <= x <= good[1] else 0


def votes(data: bytes, words: list[bytes]) -> int:
    """The labellers' votes as a base-3 number (0: no vote, 1: good, 2: bad)."""
    n = len(words)
    if n < MIN_WORDS:
        return 0
    inf = float("inf")
    chars = max(1, len(data) - n + 1)
    letters = max(1, len(data.translate(None, _ALNUM)))
    v = [
        _vote(len(data.translate(None, _KEEP_SYMBOLS)) / chars, (0, 0.08)),
        _vote(len(data.translate(None, _ASCII_UPPER)) / letters, (0, 0.5)),
        _vote(sum(map(_SEPARATORS.__contains__, words)) / n, (0, 0.15)),
        _vote(sum(map(eq, words, words[1:])) / n, (0, 0.3)),
        _vote(sum(map(data.count, _DECORATIONS)) / n, (0, 0.2)),
        _vote(letters / chars, (0.6, 1)),
        0 if n < 50 else _vote(len(set(words)) / n ** 0.75, (0.5, inf), (1.0, inf)),
        _vote(sum(map(data.count, (b".", b"?", b"\xe2\x80\xa6", b"\xe3\x80\x82"))) / n, (0, 1.0), (0.02, 0.6)),
        _vote(chars / n, (2, 20), (2.5, 11)),
    ]
    code = 0
    for x in v:
        code = code * 3 + x
    return code


def shape(word: bytes) -> bytes:
    """Letter case or digits of a word and up to three marks at its end; of
    mixed words, runs of letters, digits and other characters."""
    core = word.rstrip(b".,;:!?*$%&#|")
    s = core if core.isascii() else core.decode("utf-8", "replace")
    if not core:
        kind = b""
    elif s.isalpha():
        kind = b"a" if s.islower() else b"A" if len(s) > 1 and s.isupper() else b"Aa"
    elif core.isdigit():
        kind = b"0"
    else:
        kind = b"m" + re.sub(rb"[a-z\x80-\xff]+", b"a", re.sub(rb"[A-Z]+", b"A", re.sub(rb"[0-9]+", b"0", core)))
    return kind + word[len(core):len(core) + 3]


class _Shapes(dict):
    """word -> hash of its shape; the words of a worker so far."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = h = zlib.crc32(shape(word))
        return h


_shapes = _Shapes()


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets and their values (shares of the words): shapes, pairs of
    neighbouring shapes, and words equal to the one before."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0)
    h = np.fromiter(map(_shapes.__getitem__, words), np.uint64, n)
    pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) >> np.uint64(17)
    same = sum(map(eq, words, words[1:]))
    count = np.bincount((np.concatenate([h, pair]) % np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
    count[BUCKETS - 1] = same
    at = np.flatnonzero(count)
    return at, count[at] / n


def fit_votes(patterns: dict[int, int], rounds: int = 100) -> tuple[float, np.ndarray, dict[int, float]]:
    """EM over pattern counts: share of good documents, vote probabilities
    [labeller, class (bad, good), vote], and each pattern's posterior (good).
    Start and pseudo-counts say that labellers are right more often than not,
    which fixes which class is which when little or nothing is bad."""
    m = len(LABELLERS)
    codes = sorted(patterns)
    v = np.array([[c // 3 ** (m - 1 - k) % 3 for k in range(m)] for c in codes], np.int64).reshape(-1, m)
    w = np.array([patterns[c] for c in codes], float)
    total = max(1.0, w.sum())
    prior = np.array([[0.45, 0.15, 0.4], [0.55, 0.4498, 0.0002]])  # class x vote
    pseudo = np.tile(prior * max(5.0, 0.002 * total), (m, 1, 1))
    pseudo[len(DEFECTS):, :, 0] = 0
    prob, share = pseudo / pseudo.sum(2, keepdims=True), 0.7
    hot = np.eye(3)[v]  # pattern x labeller x vote
    # silence answers for a defect labeller; of the others it says nothing
    hot[:, len(DEFECTS):, 0] = 0
    for _ in range(rounds):
        log = np.einsum("pmv,mcv->pc", hot, np.log(np.maximum(prob, 1e-12))) + np.log([1 - share, share])
        post = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
        mass = np.stack([w * (1 - post), w * post], 1)
        prob = np.einsum("pc,pmv->mcv", mass, hot) + pseudo
        prob /= prob.sum(2, keepdims=True)
        new = (mass[:, 1].sum() + 8) / (total + 10)
        done, share = abs(new - share) < 1e-9, new
        if done:
            break
    return share, prob, dict(zip(codes, post.tolist()))


@dataclass
class QualityModel:
    share_good: float
    #: labeller -> (right among its votes on bad, on good documents)
    accuracies: dict[str, tuple[float, float]]
    posteriors: dict[int, float]
    weights: np.ndarray
    bias: float

    def score(self, words: list[bytes]) -> float:
        """Probability that the text is good."""
        at, val = features(words)
        return float(1 / (1 + np.exp(-np.clip(self.weights[at] @ val + self.bias, -50, 50))))


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> QualityModel:
    """Votes of all documents, EM, and the scorer on the hash sample: the
    ``train_docs`` least different hashes of (doc_id, text), so repeated rows
    are one row of the sample with their number as weight."""
    h = F.xxhash64("doc_id", "text")
    least = docs.select(h.alias("h")).distinct().orderBy("h").limit(train_docs).agg(F.max("h")).first()[0]
    chosen = h <= F.lit(least) if least is not None else F.lit(False)

    def run(batches):
        for b in batches:
            out = {"pattern": [], "h": b["h"], "at": [], "val": []}
            for t, sampled in zip(b["text"], b["sampled"]):
                data = (t or "").encode("utf-8", "surrogatepass")
                words = data.split()
                out["pattern"].append(votes(data, words))
                at, val = features(words) if sampled else (None, None)
                out["at"].append(at)
                out["val"].append(val)
            yield out

    seen = stage_table(map_rows(docs.select("text", h.alias("h"), chosen.alias("sampled")), run,
                                "pattern int, h long, at array<int>, val array<float>"))
    patterns = {r.pattern: r["n"] for r in seen.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()}
    share, prob, post = fit_votes(patterns)
    one = seen.where("at is not null").groupBy("h").agg(
        F.min(F.struct("pattern", "at", "val")).alias("x"), F.count(F.lit(1)).alias("n"))
    sample = [(r.x["at"], r.x["val"], post[r.x.pattern], r["n"]) for r in one.orderBy("h").collect()]
    weights, bias = logistic(sample, BUCKETS)
    right = {n: (float(prob[k, 0, 2] / prob[k, 0, 1:].sum()), float(prob[k, 1, 1] / prob[k, 1, 1:].sum()))
             for k, n in enumerate(LABELLERS)}
    return QualityModel(share, right, post, weights, bias)


def classify(docs: DataFrame, model: QualityModel) -> DataFrame:
    """One row per document: doc_id, the labellers' votes (good, bad), the
    weak posterior, the scorer's score and ``kept``."""

    def run(batches):
        m = len(LABELLERS)
        for b in batches:
            rows = []
            for t in b["text"]:  # one text's words at a time
                data = (t or "").encode("utf-8", "surrogatepass")
                words = data.split()
                code, score = votes(data, words), model.score(words)
                each = [code // 3 ** k % 3 for k in range(m)]
                rows.append((each.count(1), each.count(2), model.posteriors[code], score, score >= THRESHOLD or not words))
            yield {"doc_id": b["doc_id"], **{k: [r[i] for r in rows] for i, k in enumerate(
                ("n_good", "n_bad", "posterior", "score", "kept"))}}

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), run,
                    "doc_id long, n_good long, n_bad long, posterior double, score double, kept boolean")


def query(spark, sf_dir: str) -> DataFrame:
    """op4: fit on all documents, classify all documents."""
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(docs))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents scored below the threshold go."""
    model = fit(docs)

    def run(batches):
        for b in batches:
            at = []
            for i, t in enumerate(b["text"]):
                words = (t or "").encode("utf-8", "surrogatepass").split()
                if not words or model.score(words) >= THRESHOLD:
                    at.append(i)
            yield {k: [c[i] for i in at] for k, c in b.items()}

    return map_rows(docs.select(*DOCUMENT_COLUMNS), run, DOCUMENTS)
