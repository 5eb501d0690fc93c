import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from clickspark.llm import wfst as T

PATH = public_tokenizers.path(T.MODEL)


@pytest.fixture(scope="module")
def machines():
    return T.Transducer(PATH, limit=2000), sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_equals_the_library(machines):
    t, sp = machines
    rng = random.Random(3)
    alphabet = list("abcdeinortsl  ▁\n\t<>0x日é🎉ла1.")
    texts = ["hello  world", " a", "a ", "\n\t x", "", " ", "   x    y", "<s> </s> <0x0A>", "ﬁ①", "\x00\x01", "        deep\n\n x"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    for x in texts:
        ids = t.encode(x)
        assert ids.tolist() == sp.encode(x)
        assert t.decode(ids) == sp.decode(ids.tolist()) == x.replace(T.MARK, " ")


def test_shortest_path_of_unigram_weights(machines):
    t, _ = machines
    u = T.Transducer(PATH)
    u.kind, u.score = T.UNIGRAM, [-(len(x) % 5) - 1.0 for x in u.text]
    word = T.MARK + "information"
    best = [0.0] + [float("inf")] * len(word)
    for j in range(1, len(word) + 1):
        for i in range(j):
            k = u.ids.get(word[i:j])
            if k is not None:
                best[j] = min(best[j], best[i] - u.score[k])
    path = u.path(word)
    assert "".join(u.text[i] for i in path) == word and sum(-u.score[i] for i in path) == best[-1]


def test_query_and_edges(spark, sf, edge, empty, machines):
    _, sp = machines
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = T.query(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.same and r.ids == sp.encode(texts[r.doc_id]) and r.n_ids == len(r.ids)
    enc = T.encode(edge, PATH)
    by = {r.doc_id: r.ids for r in enc.collect()}
    assert by[3] == by[4] == [] and len(by[6]) > 10_000
    back = {r.doc_id: r.text for r in T.decode(enc, PATH).collect()}
    assert back == {r.doc_id: r.text or "" for r in edge.collect()}
    assert T.encode(empty, PATH).count() == 0 and T.decode(T.encode(empty, PATH), PATH).count() == 0


def test_other_normalisers_are_refused(tmp_path):
    data = open(PATH, "rb").read()
    # identity normaliser message with extra white space removal switched on
    spec = b"\x0a\x08identity\x12\x00\x18\x01\x20\x00"
    assert spec in data
    bad = tmp_path / "m.model"
    bad.write_bytes(data.replace(spec, spec[:-1] + b"\x01"))
    with pytest.raises(ValueError):
        T.Transducer(str(bad))
    assert np.all(T.Transducer(PATH).encode(None) == [])
