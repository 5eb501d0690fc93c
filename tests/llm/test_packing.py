import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from clickspark.llm import packing as P

PATH = public_tokenizers.path(P.TOKENIZER)


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def test_ids_equal_the_tokenizer(plain):
    rng = random.Random(1)
    parts = list("aZ'st$.!?,: \n\t́é9_Σ²") + ["<|endoftext|>", "İ", "don't", "\x1c", "\x85", "word, "]
    texts = ["", " ", "it's  <|endoftext|>a.", "ΑΣ.Α ΣΑΣ.", "ȧ.b", "x²..y ½. a_b... $$."]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    small = P.WordTokenizer(PATH, limit=50)
    for t in texts:
        assert np.frombuffer(small.encode(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


def test_best_cuts_is_optimal():
    rng = random.Random(2)
    for _ in range(200):
        at = sorted(rng.sample(range(1, 60), rng.randrange(3, 25)))
        window = max(b - a for a, b in zip([0, *at], at)) + rng.randrange(0, 15)
        pen = [rng.choice([0, 3, 9]) for _ in at]
        cost, _ = P.best_cuts(at, pen, window)
        dp = {0: 0}
        for c, p in zip(at, pen):
            dp[c] = min(v + p + window - (c - b) for b, v in dp.items() if b < c and c - b <= window)
        assert cost == [dp[c] for c in at]


def check(pieces, texts, plain, window=P.WINDOW):
    ids = {i: plain.encode(t or "", add_special_tokens=False).ids + [1] for i, t in texts.items()}
    at, used = defaultdict(int), defaultdict(list)
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        doc = ids[p["doc_id"]]
        part = np.array(doc[p["start"]:p["start"] + p["length"]], "<u4").tobytes()
        assert p["length"] > 0 and p["doc_tokens"] == len(doc) and zlib.crc32(part) == p["ids_crc32"]
        assert p["offset"] == at[p["sequence_id"]]
        at[p["sequence_id"]] += p["length"]
        used[p["doc_id"]].append((p["start"], p["start"] + p["length"]))
    for i, doc in ids.items():
        spans = sorted(used[i])
        assert spans[0][0] == 0 and spans[-1][1] == len(doc) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    total = sum(at.values())
    assert max(at.values()) <= window
    return sum(window - n for n in at.values() if n & (n - 1)) / total


def test_query_packs_every_id_once_with_little_padding(spark, sf, plain):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    pieces = [r.asDict() for r in P.query(spark, sf).collect()]
    assert check(pieces, texts, plain) < 0.02


@pytest.mark.parametrize("horizon", [256, 4096])
def test_stream_in_small_steps(plain, horizon):
    rng = random.Random(4)
    texts = {i: " ".join(rng.choice(["word", "thing.", "and", "so", "it", "goes!"]) for _ in range(rng.choice([0, 3, 40, 900])))
             for i in range(60)}
    tok = P.WordTokenizer(PATH)
    rows = P.pack_stream(((i, tok.encode(t)) for i, t in texts.items()), tok.sentence_end, 0, window=64, horizon=horizon)
    pieces = [dict(zip(P._COLUMNS, r)) for r in rows]
    assert [p["sequence_id"] for p in pieces] == sorted(p["sequence_id"] for p in pieces)
    assert check(pieces, texts, plain, 64) < 0.12


def test_no_sentences_at_all(plain):
    tok = P.WordTokenizer(PATH)
    rows = P.pack_stream(iter([(1, tok.encode("word " * 9999)), (2, b"")]), tok.sentence_end, 0)
    pieces = [dict(zip(P._COLUMNS, r)) for r in rows]
    assert check(pieces, {1: "word " * 9999, 2: ""}, plain) < 0.1


def test_edges(spark, edge, empty, plain):
    rows = [r.asDict() for r in P.pack(edge.where("doc_id is null or doc_id <> 8"), PATH).collect()]
    texts = {r.doc_id: r.text for r in edge.where("doc_id is null or doc_id <> 8").collect()}
    check(rows, texts, plain)
    assert [r["doc_tokens"] for r in rows if r["doc_id"] == 3] == [1]
    assert P.pack(edge.where("doc_id = 8"), PATH).count() >= 2 and P.pack(empty, PATH).count() == 0
