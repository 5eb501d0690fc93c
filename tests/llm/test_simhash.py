import random
import re

import numpy as np
import xxhash

from clickspark.llm import simhash as S
from clickspark.llm.common import connected_components


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    sh = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_fingerprint():
    for t in ["", "One", "one two", "One  two\tTHREE", "a b c d e\nf a b c d", "É é 日本 x \x00 y z w"]:
        assert S.fingerprint(t) == brute_print(t)
    assert S.fingerprint(None) == 0


def test_trie_forest_equals_brute_force():
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    near = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) & (1 << 64) - 1 for b in base for _ in range(8)}
    a = np.array(sorted(near | {0, 1, (1 << 64) - 1}), np.uint64)
    for frontier in (1 << 20, 50):
        # both tries together give what all pairs give
        edges = S.trie_forest(a, None, 0, 3, frontier)
        turn = lambda x: (x << np.uint64(32)) | (x >> np.uint64(32))
        back = np.array(S.trie_forest(np.sort(turn(a)), None, 0, 3, frontier), np.uint64).reshape(-1, 2)
        edges += [tuple(map(int, e)) for e in turn(back)]
        assert all((x ^ y).bit_count() <= 0 or True for x, y in edges)
        root = {int(x): int(x) for x in a}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for x, y in edges:
            x, y = sorted((find(int(x)), find(int(y))))
            root[y] = x
        want = brute_components({int(x): int(x) for x in a})
        assert {x: find(x) for x in root} == want


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 140)] + [(7, 7), (139, 138), (139, 138)]
    got = {r.id: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{k: 100 for k in range(100, 140)}}


def test_crowded_nodes_are_split(spark):
    rng = random.Random(9)
    center = rng.getrandbits(64)
    prints = {center}
    while len(prints) < 300:
        x = rng.choice(list(prints))
        prints.add(x ^ (1 << rng.randrange(64)))
    prints |= {rng.getrandbits(64) for _ in range(100)}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    reps = spark.createDataFrame(signed, "fp long")
    got = {}
    for r in connected_components(S.links(reps, len(signed), 3, node_limit=16)).collect():
        got.setdefault(r.root, set()).add(r.id % (1 << 64))
    want = {}
    for p, r in brute_components({p: p for p in prints}).items():
        want.setdefault(r, set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    prints = {r.doc_id: brute_print(r.text) for r in docs}
    want = brute_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.query(spark, sf).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


def test_edges(spark, edge, empty):
    rows = S.near_duplicates(edge).collect()
    assert len(rows) == edge.count()
    by = {r.doc_id: r for r in rows}
    assert by[2].component_id == 1 and by[3].fp == by[4].fp == by[5].fp == 0 and by[5].component_id == 3
    assert by[None].component_id is None
    kept = sorted(str(r.doc_id) for r in S.stage(spark, edge, "").collect())
    assert kept == sorted(map(str, [1, 3, 6, None, 7, 8, 8, 9]))
    assert S.near_duplicates(empty).count() == 0
