"""Toxicity of texts after noisy-channel deobfuscation.

1. Character language model: trigram counts of the lower-cased letters of
   all documents (summed in the tasks, at most ALPHABET^3 rows).
2. Restoration: every word is a lattice. Plain words have one path. Words with
   digits or signs among letters and with runs of three or more equal letters
   have several: signs that stand for letters, runs of one or two letters,
   separators that vanish. Viterbi decoding picks the path with the least
   channel plus language-model cost. Characters spaced out in a row are one
   lattice whose gaps vanish or end a word, wide gaps more likely the latter;
   every word between two breaks that some path within MARGIN of the best one
   takes is read.
3. Score: logistic regression on the restored words and their beginnings,
   learned from a bounded sample of labelled, not held-out rows
   (``TRAIN_DOCS``); evidence is counted once per document.

A document's score depends on its text alone.  Null and empty texts score
the intercept; very long texts are read whole; repeated rows score alike;
null doc_ids count as held out; extra columns are ignored; an empty table
gives an empty result, and without labelled rows every score is 0.5."""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickspark.llm.common import logistic, map_rows, table
from clickspark.staging import stage_table

#: Labelled rows learned from (smallest id hashes), features kept, fewest
#: toxic documents and least log-odds of a feature.
TRAIN_DOCS, FEATURES, MIN_DOCS, MIN_ODDS = 20_000, 4096, 4, 1.5
#: Label folds: the remainder that is held out.
FOLDS, HELD_OUT = 5, 0

#: Fixed values of the channel: sign -> letters it may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a",
        "$": "s", "!": "i", "|": "li", "+": "t", "€": "e", "£": "l", "¥": "y", "(": "c", "<": "c", "#": "h", "*": "aeiou"}
SEPARATORS = frozenset(".-_*~'`^,:;/\\ ")
#: Channel costs (nats): sign for letter, unknown letter, repeated letters,
#: dropped separator, character that stays as it is though no letter.
C_LEET, C_WILD, C_RUN, C_DROP, C_STAY = 0.7, 2.0, 0.3, 0.7, 12.0
#: In spaced runs: a gap that ends a word, a wide gap that does or does not,
#: a doubled letter read as one; breaks looked at.  A word reaches from a break
#: to every later one within MAX_SPACED letters, and to the NEXT_BREAKS next
#: ones however far they are: without a likely break inside, no word is too long.
C_BREAK, C_WIDE_BREAK, C_WIDE_DROP, C_DOUBLE = 0.7, 0.1, 3.0, 1.5
MARGIN, MAX_SPACED, NEXT_BREAKS = 6.0, 24, 4

#: a-z are 1-26, U+00DF-U+00FF 27-59, other letters 60, all else 0.
ALPHABET = 61
_MARKS = ".,;:?\"'()[]{}…»«–—"
_EDGE = _MARKS + "!*%&$#|@€£"


def _codes() -> np.ndarray:
    t = np.zeros(0x110000, np.uint8)
    for c in range(128, 0x110000):
        if chr(c).isalpha():
            t[c] = 60
    t[97:123] = np.arange(1, 27)
    t[0xDF:0x100] = np.arange(27, 60)
    t[0xF7] = 0
    return t


_CODES: list[np.ndarray] = []


def char_codes(text: str) -> np.ndarray:
    if not _CODES:
        _CODES.append(_codes())
    return _CODES[0][np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts [a, b, c] over all texts (0: word edge, collapsed)."""

    def run(batches):
        total = np.zeros(ALPHABET ** 3, np.int64)
        for b in batches:
            texts = [t for t in b["text"] if t]
            for i in range(0, len(texts), 200):
                c = char_codes(" " + " ".join(texts[i:i + 200]) + " ").astype(np.int32)
                c = c[np.append(True, (c[1:] != 0) | (c[:-1] != 0))]
                total += np.bincount((c[:-2] * ALPHABET + c[1:-1]) * ALPHABET + c[2:], minlength=len(total))
        at = np.flatnonzero(total)
        yield {"code": at, "n": total[at]}

    rows = (map_rows(docs.select("text"), run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))
            .toPandas())  # at most ALPHABET^3 rows
    out = np.zeros(ALPHABET ** 3, np.int64)
    out[rows["code"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out.reshape(ALPHABET, ALPHABET, ALPHABET)


def language_model(counts: np.ndarray, k: float = 5.0) -> np.ndarray:
    """-log P(c | a, b), interpolated with lower orders."""
    one = counts.sum((0, 1)) + 1.0
    one /= one.sum()
    two = counts.sum(0).astype(float)
    two = (two + k * one) / (two.sum(1, keepdims=True) + k)
    three = (counts + k * two) / (counts.sum(2, keepdims=True) + k)
    return -np.log(three).astype(np.float32)


def lattice(word: str) -> list[list[tuple[str, float, int]]]:
    """Arcs (letters, channel cost, next position) from every position."""
    arcs: list[list[tuple[str, float, int]]] = [[] for _ in word]
    n = len(word)
    for i, c in enumerate(word):
        if c.isalpha():
            arcs[i].append((c, 0.0, i + 1))
        if c in LEET:
            arcs[i] += [(x, C_WILD if c == "*" else C_LEET, i + 1) for x in LEET[c]]
        if c in SEPARATORS and 0 < i < n - 1:
            arcs[i].append(("", C_DROP, i + 1))
        if not c.isalpha():
            arcs[i].append((" ", C_STAY, i + 1))
        if not (c.isalpha() or c in LEET) or (i and word[i - 1] == c):
            continue
        j = i + 1
        while j < n and word[j] == c:
            j += 1
        if j - i >= 3:
            for x in (c if c.isalpha() else LEET[c]):
                arcs[i] += [(x, C_RUN, j), (x + x, C_RUN, j)]
    return arcs


def _letters(node, stop=None) -> str:
    """The letters of a path of (position, node before, letters), from ``stop`` on."""
    out = []
    while node is not stop:
        out.append(node[2])
        node = node[1]
    return "".join(reversed(out))


def _before(a, b) -> bool:
    """Whether path ``a`` reads before path ``b``; compared from where they part."""
    x, y = a, b
    while x is not y:
        if y is None or x is not None and x[0] >= y[0]:
            x = x[1]
        else:
            y = y[1]
    return _letters(a, x) < _letters(b, x)


def restore(word: str, lm: list) -> str:
    """The least-cost reading of a word's lattice.  States hold the node
    they were reached from, not what was read, so memory is linear."""
    arcs = lattice(word)
    codes = {c: int(char_codes(c)[0]) if c != " " else 0 for a in arcs for s, _, _ in a for c in s}
    best: list[dict] = [{} for _ in range(len(word) + 1)]
    best[0][0, 0] = (0.0, None)
    for i, a in enumerate(arcs):
        for (p, q), (cost, node) in best[i].items():
            for s, extra, j in a:
                u, v, c = p, q, cost + extra
                for ch in s:
                    w = codes[ch]
                    if not (w == 0 == v):
                        c += lm[u][v][w]
                    u, v = v, w
                old = best[j].get((u, v))
                if old is None or c < old[0]:
                    best[j][u, v] = (c, (j, node, s))
                elif c == old[0]:
                    new = (j, node, s)
                    if _before(new, old[1]):
                        best[j][u, v] = (c, new)
        best[i] = {}
    cost, node = math.inf, None
    for (u, v), (c, end) in best[-1].items():
        c += lm[u][v][0]
        if c < cost or c == cost and _before(end, node):
            cost, node = c, end
    return _letters(node)


#: Characters, alone or two or three alike, with gaps between.
_SPACED = re.compile(r"(?<!\S)(\S)\1{0,2}(?!\S)(?:\s+(\S)\2{0,2}(?!\S))+")
_GAP = re.compile(r"\s+")


def spaced_lattice(run: str) -> list[list[tuple[str, float, int]]]:
    """Arcs of a spaced run, its gaps written as " " (narrow) or "\\n" (wide)."""
    arcs = lattice(run)
    for i, c in enumerate(run):
        if c in " \n":
            wide = c == "\n"
            arcs[i] = [("", C_WIDE_DROP if wide else C_DROP, i + 1), (" ", C_WIDE_BREAK if wide else C_BREAK, i + 1)]
        elif c.isalpha() or c in LEET:
            j = i  # the same character again, over the gaps
            while j + 2 < len(run) and run[j + 2] == c and run[j + 1] in " \n" and j < i + 4:
                j += 2
            if j == i and run[i + 1:i + 2] == c:
                j = i + 1
            if j > i:
                arcs[i] += [(x, C_DOUBLE, k) for x in (c if c.isalpha() else LEET[c])
                            for k in ({j + 1} if j == i + 1 else range(i + 3, j + 2, 2))]
    return arcs


def _spelled(chain) -> str:
    """The word of a chain (word before, letters)."""
    out = []
    while chain is not None:
        chain, s = chain
        out.append(s)
    return "".join(reversed(out))


def spaced_words(run: str, lm: list) -> set[str]:
    """Words of a spaced run: between any two breaks that some path within
    MARGIN of the best one takes, the least-cost reading without a break, and
    the one that also keeps doubled letters."""
    arcs, n = spaced_lattice(run), len(run)
    codes = {c: int(char_codes(c)[0]) if c != " " else 0 for a in arcs for s, _, _ in a for c in s}

    def step(state, s, extra):
        (u, v), c = state, extra
        for ch in s:
            w = codes[ch]
            if not (w == 0 == v):
                c += lm[u][v][w]
            u, v = v, w
        return (u, v), c

    ahead: list[dict] = [{} for _ in range(n + 1)]
    ahead[0][0, 0] = 0.0
    for i, a in enumerate(arcs):
        for state, cost in ahead[i].items():
            for s, extra, j in a:
                to, c = step(state, s, extra)
                if cost + c < ahead[j].get(to, math.inf):
                    ahead[j][to] = cost + c
    back: list[dict] = [{} for _ in range(n)] + [{(u, v): lm[u][v][0] for u, v in ahead[n]}]
    through = [math.inf] * (n + 1)
    for i in range(n - 1, -1, -1):
        for state, cost in ahead[i].items():
            least = math.inf
            for s, extra, j in arcs[i]:
                to, c = step(state, s, extra)
                c += back[j][to]
                least = min(least, c)
                if s == " ":
                    through[i] = min(through[i], cost + c)
            back[i][state] = least
    bound = back[0][0, 0] + MARGIN
    ends = {i for i in range(n) if through[i] <= bound} | {n}
    breaks, out = sorted(ends), set()
    for start in [0, *(i + 1 for i in breaks if i < n)]:
        after = breaks[bisect_left(breaks, start):][:NEXT_BREAKS]
        reach = min(n, max(start + 2 * MAX_SPACED, after[-1]))
        best: list[dict] = [{} for _ in range(reach - start + 1)]
        best[0][(0, 0), False] = (0.0, None)
        for i in range(start, reach + 1):
            here = best[i - start]
            if i in ends:
                for kind in (False, True):
                    out.add(min(((c + lm[u][v][0], _spelled(w)) for ((u, v), k), (c, w) in here.items() if k == kind),
                                default=(0.0, ""))[1])
            if i == reach:
                break
            for (state, kind), (cost, word) in here.items():
                for s, extra, j in arcs[i]:
                    if s != " " and j <= reach:
                        to, c = step(state, s, extra)
                        key, new = (to, kind or extra == C_DOUBLE), (cost + c, (word, s))
                        old = best[j - start].get(key)
                        if old is None or new[0] < old[0] or new[0] == old[0] and _spelled(new[1]) < _spelled(old[1]):
                            best[j - start][key] = new
    out.discard("")
    return out


_RUN = re.compile(r"(.)\1\1")


def _ambiguous(core: str) -> bool:
    if core.isalpha():
        return bool(_RUN.search(core))
    return any(c.isalpha() for c in core)


@dataclass
class Restorer:
    """Words of a text, restored; readings are remembered (at most ``limit``)."""
    lm: np.ndarray
    limit: int = 400_000
    known: dict[str, tuple[str, ...]] = field(default_factory=dict)
    table: list = field(default_factory=list)

    def words(self, token: str) -> tuple[str, ...]:
        core = token.strip(_EDGE)
        if not core:
            return ()
        # signs at the ends may stand for letters: one or two money signs
        full = token.strip(_MARKS).rstrip("!")
        ends = full.replace(core, "", 1)
        if not (0 < len(ends) <= 2 and set(ends) <= set("$@€£")):
            full = core
            if not _ambiguous(core):
                return (core,)
        if not self.table:
            self.table = self.lm.tolist()
        return tuple(w for w in restore(full, self.table).split(" ") if w)

    def text(self, text: str | None) -> set[str]:
        """Distinct restored words of a text."""
        low = (text or "").lower()
        tokens = low.split()
        extra: list[str] = []
        for m in _SPACED.finditer(low):
            run = m[0]
            if any(map(str.isalpha, run)):
                extra.append(_GAP.sub(lambda g: " " if len(g[0]) == 1 and g[0] != "\n" else "\n", run))
        out: set[str] = set()
        known = self.known
        for t in set(tokens):
            w = known.get(t)
            if w is None:
                if len(known) >= self.limit:
                    known.clear()
                known[t] = w = self.words(t)
            out.update(w)
        for t in extra:
            w = known.get(t)
            if w is None:
                if len(known) >= self.limit:
                    known.clear()
                if not self.table:
                    self.table = self.lm.tolist()
                known[t] = w = tuple(spaced_words(t, self.table))
            out.update(w)
        return out


def word_features(word: str) -> list[int]:
    """Hashes of a restored word and of its beginnings of 3 to 6 letters."""
    return [zlib.crc32(f"={word}".encode("utf-8", "surrogatepass")),
            *(zlib.crc32(word[:k].encode("utf-8", "surrogatepass")) for k in range(3, min(6, len(word)) + 1))]


@dataclass
class ToxicityModel:
    lm: np.ndarray
    #: feature hash -> place in ``weights``
    places: dict[int, int]
    weights: np.ndarray
    bias: float

    def scorer(self):
        """text -> score, with its own memory of words."""
        restorer, places, seen = Restorer(self.lm), self.places, {}

        def hits(word: str) -> tuple[int, ...]:
            return tuple(places[f] for f in word_features(word) if f in places)

        def found(text: str | None) -> set[int]:
            out: set[int] = set()
            if len(seen) > 500_000:
                seen.clear()
            for w in restorer.text(text):
                h = seen.get(w)
                if h is None:
                    seen[w] = h = hits(w)
                if h:
                    out.update(h)
            return out

        def score(text: str | None) -> float:
            s = self.bias + float(self.weights[sorted(found(text))].sum())
            return 1 / (1 + math.exp(-max(-50.0, min(50.0, s))))

        score.found = found
        return score


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> ToxicityModel:
    """Language model of all texts; weights from the labelled sample."""
    lm = language_model(trigram_counts(docs))
    chosen = (labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull())
              .groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("label_id"), "label_id").limit(train_docs))
    # at most train_docs narrow rows: a proven bound for the broadcast
    sample = (docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
              .select("text", "toxic"))

    def words(batches):
        restorer = Restorer(lm)
        for b in batches:
            yield {"toxic": b["toxic"], "words": [sorted(restorer.text(t)) for t in b["text"]]}

    sample = stage_table(map_rows(sample, words, "toxic int, words array<string>"))
    counts = {r.toxic: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = counts.get(1, 0), counts.get(0, 0)

    def seen(batches):
        tally: list[dict[int, int]] = [{}, {}]
        for b in batches:
            for y, ws in zip(b["toxic"], b["words"]):
                t = tally[y == 1]
                for f in {f for w in ws for f in word_features(w)}:
                    t[f] = t.get(f, 0) + 1
        for y, t in enumerate(tally):
            keys = list(t)
            yield {"feature": keys, "bad": [t[k] * y for k in keys], "good": [t[k] * (1 - y) for k in keys]}

    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    top = (map_rows(sample, seen, "feature long, bad long, good long").groupBy("feature")
           .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where(F.col("bad") >= MIN_DOCS)
           .withColumn("odds", odds).where(F.col("odds") >= MIN_ODDS)
           .orderBy((F.col("odds") * F.sqrt("bad")).desc(), "feature").limit(FEATURES).collect())
    places = {r.feature: k for k, r in enumerate(top)}

    def found(batches):
        for b in batches:
            yield {"toxic": b["toxic"], "at": [sorted({places[f] for w in ws for f in word_features(w) if f in places})
                                               for ws in b["words"]]}

    rows = [(r["at"], [1.0] * len(r["at"]), float(r.toxic == 1))
            for r in map_rows(sample, found, "toxic int, at array<int>").collect()]
    weights, bias = logistic(rows, max(1, len(places)), balance=False, rounds=2000, l2=1e-6)
    return ToxicityModel(lm, places, weights, bias)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score, predicted, for every document."""

    def run(batches):
        s = model.scorer()
        for b in batches:
            scores = [s(t) for t in b["text"]]
            yield {"doc_id": b["doc_id"], "score": scores, "predicted": [int(x >= 0.5) for x in scores]}

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), run,
                    "doc_id long, score double, predicted int")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: contract columns over all documents."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
