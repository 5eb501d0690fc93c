"""Line-first quality rules.

Every line of a document is judged by itself (symbols, navigation,
boilerplate, shouting, stutter, missing punctuation, repeats); failing lines are
removed, and a document that loses more than ``max_lost`` of its words is
rejected, as is one that fails the base rules (too few words, or too many
words inside repeated 8-word windows).

Everything happens in the scan's own tasks: no shuffle, one text in memory
at a time beside its batch.  Null texts have no words, so they fail the base
rules; empty texts likewise; repeated rows get equal verdicts; columns other
than doc_id and text are ignored (the pipeline stage keeps those of
``documents``); an empty table gives an empty result."""

from __future__ import annotations

import re
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickspark.llm.common import DOCUMENT_COLUMNS, DOCUMENTS, map_rows, table

#: Contract values: fewest words, window of repeated words, their share (%).
MIN_WORDS, WINDOW, MAX_REPEAT_PCT = 20, 8, 30
#: A document may lose this share of its words by failing lines.
MAX_LOST = 0.5
SYMBOLS = b"#*$%&|<>"
_NO_SYMBOLS = bytes(b for b in range(256) if b not in SYMBOLS)

BOILERPLATE = re.compile(
    rb"all rights reserved|licensed under|general public license|cookie policy|privacy policy|terms of (?:use|service)|"
    rb"subscribe to our|sign up for our|accept (?:all )?cookies|copyright \(c\)|powered by|click here|enable javascript",
    re.I)
NAV_WORDS = frozenset(b"home login logout register menu next previous prev search contact about sitemap share print "
                      b"back top skip sign-in sign-up".split())
_SEPARATORS = frozenset((b"|", b">", b"/", b"\xc2\xbb", b"\xe2\x80\xa2", b"-", b"\xc2\xb7"))
_ASCII_MARK = re.compile(rb"[.,;:!?]")
#: Marks of many scripts; Thai and Lao, which write without, count as marked.
_MARK = re.compile("[\u2026\u3001\u3002\uff01\uff0c\uff0e\uff1a\uff1b\uff1f\u060c\u061b\u061f\u06d4\u0964\u0965"
                   "\u037e\u0387\u0589\u1362-\u1368\u104a\u104b\u17d4-\u17d6\u0f0b-\u0f0e\u0e00-\u0eff]")
#: From so many words on a line needs a mark; so many shorter lines in a row
#: need one among them.
MARKED, SHORT_RUN = 10, 5


def _unmarked(line: bytes) -> bool:
    return not _ASCII_MARK.search(line) and not _MARK.search(line.decode("utf-8", "replace"))



def _symbols(data: bytes) -> int:
    return len(data.translate(None, _NO_SYMBOLS))


def line_fault(line: bytes, words: list[bytes]) -> str | None:
    """Name of the rule that a non-empty line breaks, or None."""
    n = len(words)
    if _symbols(line) * 100 > 15 * (len(line) - n + 1):
        return "symbols"
    if n >= 5 and sum(w in _SEPARATORS for w in words) * 4 >= n:
        return "navigation"
    if n <= 4 and all(w.lower().strip(b"|>/") in NAV_WORDS for w in words):
        return "navigation"
    if n <= 30 and BOILERPLATE.search(line):
        return "boilerplate"
    if n >= 5 and line.decode("utf-8", "replace").isupper():
        return "shouting"
    if n >= 10 and sum(map(eq, words, words[1:])) * 2 >= n:
        return "stutter"
    if n >= MARKED and _unmarked(line):
        return "punctuation"
    return None


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a ``window``-word span found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    acc = np.zeros(n, np.uint64)
    for k in range(window):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + (h[k:k + n] ^ np.uint64(k))
    order = np.argsort(acc, kind="stable")
    equal = acc[order[1:]] == acc[order[:-1]]
    if not equal.any():
        return 0
    # windows with an equal hash are compared by their words
    hit = np.zeros(n, bool)
    seen: dict[tuple, int] = {}
    for i in np.sort(order[np.append(equal, False) | np.insert(equal, 0, False)]).tolist():
        first = seen.setdefault(tuple(words[i:i + window]), i)
        if first != i:
            hit[first] = hit[i] = True
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def judge(text: str | None, max_lost: float = MAX_LOST) -> dict:
    """All figures of one text, the verdict and the cleaned text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words: list[bytes] = []
    lines = data.split(b"\n")
    seen: set[bytes] = set()
    dup = 0
    found: dict[int, tuple[str, int]] = {}  # line -> fault, words
    run: list[tuple[int, int]] = []  # short lines without a mark, one after the other

    def end_run():
        if len(run) >= SHORT_RUN:
            found.update((i, ("punctuation", k)) for i, k in run if i not in found)
        run.clear()

    for i, line in enumerate(lines):
        own = line.split()
        if not own:
            continue
        words += own
        fault = line_fault(line, own)
        if line in seen:
            dup += 1
            fault = fault or "repeat"
        seen.add(line)
        if fault:
            found[i] = fault, len(own)
        if len(own) < MARKED and _unmarked(line):
            run.append((i, len(own)))
        else:
            end_run()
    end_run()
    faults = [found[i][0] for i in sorted(found)]
    lost = sum(k for _, k in found.values())
    kept_lines = [line for i, line in enumerate(lines) if i not in found]
    n, rep = len(words), repeated_words(words)
    base_failed = n < MIN_WORDS or 100 * rep > MAX_REPEAT_PCT * n
    kept = not base_failed and lost <= max_lost * n
    spaces = sum(data.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    return {"n_words": n, "word_chars": len(text or "") - spaces, "n_symbols": _symbols(data), "n_dup_lines": dup,
            "n_repeat_words": rep, "base_failed": base_failed, "kept": kept, "lost_words": lost,
            "faults": faults, "cleaned": b"\n".join(kept_lines).decode("utf-8", "surrogatepass") if faults else text}


_FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_words")


def quality_rules(docs: DataFrame, max_lost: float = MAX_LOST, texts: bool = True) -> DataFrame:
    """One row per document: figures, base_failed, kept, and with ``texts``
    the names of the rules that removed lines and the cleaned text."""
    schema = ("doc_id long, " + ", ".join(f"{k} long" for k in _FIGURES) + ", base_failed boolean, kept boolean"
              + ", faults array<string>, cleaned string" * texts)

    def run(batches):
        for b in batches:
            rows = [judge(t, max_lost) for t in b["text"]]
            names = (*_FIGURES, "base_failed", "kept", *("faults", "cleaned") * texts)
            yield {"doc_id": b["doc_id"], **{k: [r[k] for r in rows] for k in names}}

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: contract columns over all documents."""
    return quality_rules(table(spark, sf_dir, "documents"), texts=False)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rejected documents go; the others lose failing lines."""

    def run(batches):
        for b in batches:
            rows = [judge(t) for t in b["text"]]
            at = [i for i, r in enumerate(rows) if r["kept"]]
            texts = [rows[i]["cleaned"] for i in at]
            yield {"doc_id": [b["doc_id"][i] for i in at], "text": texts, "lang": [b["lang"][i] for i in at],
                   "source": [b["source"][i] for i in at], "n_chars": list(map(len, texts))}

    return map_rows(docs.select(*DOCUMENT_COLUMNS), run, DOCUMENTS)
