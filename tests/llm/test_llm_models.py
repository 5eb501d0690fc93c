import math
import random
import tracemalloc
import zlib

import numpy as np

from clickspark.llm import quality_model as Q
from clickspark.llm import toxicity as X


def sf_big(sf):
    return sf.replace("0.001", "0.01")


def test_em_finds_accurate_labellers():
    rng = np.random.default_rng(1)
    m, d = len(Q.LABELLERS), len(Q.DEFECTS)
    counts, truth = {}, {}
    for _ in range(4000):
        good = rng.random() < 0.85
        v = [0] * m
        for k in range(m):
            if k < d:
                v[k] = 2 if rng.random() < (0.01 if good else 0.5) else 0
            elif rng.random() < 0.8:
                v[k] = 1 if rng.random() < (0.95 if good else 0.4) else 2
        code = 0
        for x in v:
            code = code * 3 + x
        counts[code] = counts.get(code, 0) + 1
        truth.setdefault(code, []).append(good)
    share, prob, post = Q.fit_votes(counts)
    assert abs(share - 0.85) < 0.05 and np.all(abs(prob[:d, 0, 2] - 0.5) < 0.12)
    right = sum(sum(t == (post[c] >= 0.5) for t in ts) for c, ts in truth.items())
    assert right > 0.95 * 4000


def test_em_without_junk_stays_on_its_side():
    code = sum(1 * 3 ** k for k in range(3))
    share, _, post = Q.fit_votes({code: 1000, 0: 50})
    assert share > 0.95 and min(post.values()) > 0.9
    assert Q.fit_votes({})[2] == {}


def test_quality_query_on_labels(spark, sf):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_big(sf)}/labels.parquet").collect()}
    rows = Q.query(spark, sf_big(sf)).collect()
    assert len(rows) == 1000
    good = [r.kept for r in rows if labels.get(r.doc_id) == 1]
    bad = [r.kept for r in rows if labels.get(r.doc_id) == 0]
    assert sum(good) >= 0.995 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_quality_edges(spark, edge, empty):
    model = Q.fit(edge)
    rows = Q.classify(edge, model).collect()
    assert len(rows) == edge.count() and all(r.kept for r in rows if r.doc_id in (3, 4, 5))
    out = Q.stage(spark, edge, "")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and out.count() == edge.count()
    assert Q.classify(empty, Q.fit(empty)).count() == 0


def test_the_sample_is_bounded_whatever_repeats(spark):
    """50,000 equal rows are one row of the sample."""
    from pyspark.sql import functions as F
    same = spark.range(50_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    rest = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("Some words, number "), F.col("id"), F.lit(". And more.")).alias("text"))
    sizes, real = [], Q.logistic
    Q.logistic = lambda rows, *a, **k: sizes.append([r[3] for r in rows]) or real(rows, *a, **k)
    try:
        Q.fit(same.union(rest), train_docs=200)
        Q.fit(same.union(rest))
    finally:
        Q.logistic = real
    assert len(sizes[0]) == 200 and len(sizes[1]) == 301 and max(sizes[1]) == 50_000


def test_shapes():
    assert Q.shape(b"a" * 23 + b"1" + b"B" * 9) != Q.shape(b"a" * 23 + b"1" + b"-" * 9)
    assert Q.shape(b"x1" * 500) != Q.shape(b"x1" * 501)
    assert [Q.shape(w) for w in (b"word", b"Word", b"WORD!!", b"12", "é".encode(), b"a1-B", b"***")] == [
        b"a", b"Aa", b"A!!", b"0", b"a", b"ma0-A", b"***"]


def brute_restore(word, lm):
    """All paths of the lattice, least cost."""
    arcs = X.lattice(word)
    best = (math.inf, "")

    def walk(i, ctx, cost, out):
        nonlocal best
        if i == len(word):
            best = min(best, (cost + lm[ctx[0]][ctx[1]][0], out))
            return
        for s, extra, j in arcs[i]:
            u, v, c = *ctx, cost + extra
            for ch in s:
                w = 0 if ch == " " else int(X.char_codes(ch)[0])
                if not (w == 0 == v):
                    c += lm[u][v][w]
                u, v = v, w
            walk(j, (u, v), c, out + s)

    walk(0, (0, 0), 0.0, "")
    return best[1]


def test_viterbi_equals_all_paths(spark):
    docs = spark.createDataFrame([(1, "an idiot and a loser said stupid things to the moron " * 3), (2, None), (3, "")],
                                 "doc_id long, text string")
    counts = X.trigram_counts(docs)
    c = X.char_codes("xid")
    assert counts[0, c[1], c[2]] == 3 and counts.sum() > 100
    lm = X.language_model(counts).tolist()
    for w in ("1d10t", "l0s3r", "stuuupid", "m.o.r-o-n", "i d i o t", "st*p1d", "a$$", "111"):
        assert X.restore(w, lm) == brute_restore(w, lm), w
    r = X.Restorer(np.array(lm, np.float32))
    for w in ("1d10t", "i d i o t", "idiooot", "(1diot)", "I.D.I.O.T"):
        assert "idiot" in r.text(w), w
    assert r.text("plain words, (here) 12 !!!") == {"plain", "words", "here", "12"}
    assert r.text(None) == set()


def string_restore(word, lm):
    """Viterbi that holds every state's whole reading."""
    arcs = X.lattice(word)
    best = [{} for _ in range(len(word) + 1)]
    best[0][0, 0] = (0.0, "")
    for i, a in enumerate(arcs):
        for (p, q), (cost, out) in best[i].items():
            for s, extra, j in a:
                u, v, c = p, q, cost + extra
                for ch in s:
                    w = 0 if ch == " " else int(X.char_codes(ch)[0])
                    if not (w == 0 == v):
                        c += lm[u][v][w]
                    u, v = v, w
                if (u, v) not in best[j] or (c, out + s) < best[j][u, v]:
                    best[j][u, v] = (c, out + s)
    return min((c + lm[u][v][0], out) for (u, v), (c, out) in best[-1].items())[1]


def test_restoration_of_long_tokens_takes_linear_memory():
    counts = np.random.default_rng(3).integers(0, 50, (X.ALPHABET,) * 3)
    lm, flat = X.language_model(counts).tolist(), np.zeros((X.ALPHABET,) * 3).tolist()
    draw = random.Random(4)
    for _ in range(300):
        w = "".join(draw.choices("ab1il|*-. 00$s", k=draw.randint(1, 40)))
        for m in (lm, flat):  # without a language model most readings cost the same
            assert X.restore(w, m) == string_restore(w, m), w
    peaks = []
    for n in (10_000, 20_000):
        w = "".join(draw.choices("0123456789abcdef", k=n))
        tracemalloc.start()
        assert len(X.restore(w, lm)) >= 0.9 * n
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 2.6 * peaks[0] and peaks[1] < 100 << 20


def test_spaced_words_in_a_row(spark):
    prose = "you are an idiot and a loser who said stupid things to the moron and that scum on the ass " * 20
    docs = spark.createDataFrame([(1, prose)], "doc_id long, text string")
    r = X.Restorer(X.language_model(X.trigram_counts(docs)))
    for phrase, words in (("a i d i o t", "idiot"), ("a l o s e r", "loser"), ("y o u i d i o t", "you idiot"),
                          ("y o u a r e a n i d i o t", "are idiot"), ("u r s c u m", "scum"), ("a s s", "ass"),
                          ("a m o r o n", "moron"), ("s t u p i d m o r o n", "stupid moron"),
                          ("y o u  i d i o t", "you idiot"), ("s t u p i d\ni d i o t", "stupid idiot"),
                          ("i d ii o t", "idiot"), ("i i d d i o t", "idiot"), ("1 d 1 o t", "idiot")):
        assert set(words.split()) <= r.text(f"well then, {phrase} indeed"), phrase
    long = "antidisestablishmentarianism is a long word and so is pneumonoultramicroscopicsilicovolcanoconiosis here " * 20
    r2 = X.Restorer(X.language_model(X.trigram_counts(spark.createDataFrame([(1, long)], "doc_id long, text string"))))
    for word in ("antidisestablishmentarianism", "pneumonoultramicroscopicsilicovolcanoconiosis"):
        assert word in r2.text(f"and then {' '.join(word)} here"), word
    assert r.text("x 1 2 3 4 y") >= {"x", "y", "1"} and len(r.text("a " * 20_000)) < 50


def test_toxicity_query_held_out(spark, sf):
    big = sf.replace("0.001", "0.1")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    rows = X.query(spark, big).collect()
    assert len(rows) == 10_000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    test = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    pos, neg = ([s for s, y in test if y == k] for k in (1, 0))
    auc = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg))
    assert auc > 0.95
    assert sum(s >= 0.5 for s in neg) <= 0.01 * len(neg) and sum(s >= 0.5 for s in pos) >= 0.8 * len(pos)


def test_toxicity_edges(spark, edge, empty):
    labels = spark.createDataFrame([(1, 1, 1), (6, 1, 0), (None, 0, 1), (7, None, None)],
                                   "doc_id long, quality int, toxic int")
    model = X.fit(edge, labels)
    rows = X.score(edge, model).collect()
    assert len(rows) == edge.count() and len({r.score for r in rows if r.doc_id in (3, 4, 5)}) == 1
    assert X.score(empty, X.fit(empty, labels.limit(0))).count() == 0
    assert {r.score for r in X.score(edge, X.fit(edge, labels.limit(0))).collect()} == {0.5}
