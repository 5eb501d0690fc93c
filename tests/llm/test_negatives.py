"""Hard negatives against all scored pairs."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from clickspark.llm import negatives as N

NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, damage=True):
    """rows: (vec_id, embedding, label)."""
    kept = []
    for i, v, label in rows:
        if label is None or label != label or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if damage and i is not None and i % 7 == 0:
            label = math.fmod(label + 1, 10)
        row = (i, int(label), tuple(math.floor(256 * float(x)) for x in v))
        if row not in kept:
            kept.append(row)
    out = []
    for a in kept:
        if a[0] is None or a[0] % 100:
            continue
        def key(b):
            s = sum(x * y for x, y in zip(a[2], b[2]))
            return (-s, b[0] is None, b[0] or 0)
        pos = sorted((b for b in kept if b[1] == a[1] and b is not a), key=key)[:5]
        neg = sorted((key(b), b[0]) for b in kept if b[1] != a[1])
        for p in pos:
            ps = -key(p)[0]
            hits = [(-k[0], i) for k, i in neg if 80 * ps <= -100 * k[0] <= 100 * ps][:5]
            out += [(a[0], p[0], r, i, ps, s) for r, (s, i) in enumerate(hits, 1)]
    return out


def same(df, rows):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got = sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=key)
    assert got == sorted(brute(rows), key=key)
    return got


def test_query_on_given_rows(spark, sf):
    rows = [(int(i), [float(x) for x in v], int(c)) for i, v, c in
            pd.read_parquet(f"{sf}/embeddings.parquet")[["vec_id", "embedding", "label"]].itertuples(index=False)]
    assert same(N.query(spark, sf), rows)


def by_hand():
    rng = random.Random(3)
    vec = lambda: [rng.choice([0.0, 0.25, 0.5, -0.25, 1.0]) for _ in range(4)]
    rows = [(i, vec(), rng.randint(0, 2)) for i in range(-100, 260)]
    rows += [(None, vec(), 1) for _ in range(5)] + [(300, None, 1), (301, vec(), None), (400, [0.1, None, 1.0, 2.0], 1),
             (500, [float("nan")] * 4, 1), (500, [float("inf"), 0.0, 0.0, 0.0], 1), (600, [], 1), (700, [1.0, 1.0], 2),
             (800, [1.0] * 9, 0)]
    rows += [(0, vec(), 1), (100, vec(), 2)]               # ids met twice with other contents
    rows += [rows[10]] * 40 + [(200, vec(), 1)] * 3        # repeated rows
    return rows


@pytest.fixture()
def small_blocks(monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 19)
    monkeypatch.setattr(N, "ANCHORS", 2)


@pytest.mark.parametrize("most", [8 << 20, -1])
def test_nulls_ties_repeats_and_blocks(spark, tmp_path, monkeypatch, small_blocks, most):
    """In one broadcast and in lanes."""
    monkeypatch.setattr(N, "BROADCAST", most)
    rows = by_hand()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", row int, windows int")
    df.repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert same(N.query(spark, str(tmp_path)), rows)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = N.query(spark, str(tmp_path))
    assert out.columns == NAMES and out.count() == 0


def test_scores_are_exact():
    big = np.array([[1 << 40, 3, -7], [-(1 << 30), 1 << 31, 5]])
    assert (N.scores(big, big[:, :2])[0, 0], N.scores(big, big)[1, 1]) == (N._LONG.max, (1 << 60) + (1 << 62) + 25)


def test_keys_sort_like_their_values():
    rng = random.Random(4)
    vals = [rng.choice([-5, 0, 7, 2 ** 62, -2 ** 62]) for _ in range(50)]
    k = np.zeros(50, N._KEY)
    k["score"] = ~N._up(vals)
    order = sorted(range(50), key=lambda i: (k[i].tobytes(), i))
    assert [vals[i] for i in order] == sorted(vals, reverse=True)
    assert N._down(~k["score"].astype(np.uint64)).tolist() == vals


def test_other_settings(spark):
    rows = [(100, [1.0], 0), (1, [0.9], 0), (2, [0.5], 0), (3, [0.85], 1), (4, [0.45], 1), (5, [0.44], 1)]
    df = N.quantised(spark.createDataFrame(rows, SCHEMA), 100)
    got = N.hard_negatives(df, N.F.col("vec_id") == 100, positives=2, negatives=1, low=1, high=2).collect()
    assert sorted((r["positive_id"], r["negative_id"]) for r in got) == [(1, 3), (2, 4)]
