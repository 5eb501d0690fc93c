"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by a
binary-trie self-join.

The trie is walked as pairs of nodes of equal depth.  A pair carries the
number of bits in which its two prefixes differ and is pruned when that
exceeds the error budget.  Two tries are used, one on the fingerprint and
one with its halves swapped: of two fingerprints that differ in ``max_bits``
bits, one half differs in at most ``max_bits // 2``, so each trie allows only
that many errors in its first 32 levels and ``max_bits`` below.

* Spark holds the upper part of the walk: a frame of node pairs, expanded
  until both nodes hold at most ``node_limit`` distinct fingerprints (dense
  clusters are expanded further, down to single fingerprints), then
* each remaining node pair is one group whose lower part is walked in numpy,
  returning a spanning forest of the links found (never the pairs), and
* connected components join the forests.

Rows: null and word-less texts have fingerprint zero and are linked like any
other; repeated rows and equal texts share a fingerprint, hence a component;
null doc_ids take part but never name a component unless it has no other id
(then component_id is null); extra columns are ignored; an empty table gives
an empty result."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickspark.llm.common import DOCUMENT_COLUMNS, connected_components, importable, map_rows, table
from clickspark.staging import stage_table

#: Contract values of the registered query and of the pipeline stage.
SHINGLE, MAX_BITS, SEED = 3, 3, 42
#: Distinct fingerprints of a trie node that one task walks by itself.
NODE_LIMIT = 2048
#: Levels added when a crowded node pair is expanded.
STEP = 4


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of a text (A-Z lower-cased, ASCII white space
    separates words, fewer words than a shingle: the whole sequence)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(line, seed)]
    else:
        at = list(accumulate([len(w) + 1 for w in words], initial=0))
        h = xxhash.xxh64_intdigest
        hashes = [h(line[a:b - 1], seed) for a, b in zip(at, at[shingle:])]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(ones, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle, seed) for t in b["text"]], np.uint64)
            yield {"doc_id": b["doc_id"], "fp": fps.view(np.int64)}

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, fp long")


def _budget(depth: int, max_bits: int) -> int:
    return max_bits // 2 if depth <= 32 else max_bits


def trie_forest(a: np.ndarray, b: np.ndarray | None, depth: int, max_bits: int,
                frontier: int = 1 << 20) -> list[tuple[int, int]]:
    """Walk the node pairs below two trie nodes (sorted distinct ``uint64``
    below each; ``b`` None: the node with itself) and return a spanning
    forest of all links as pairs (member, smaller member)."""
    same, b = b is None, a if b is None else b
    depths = [depth, *range(depth + 4 - depth % 4, 65, 4)] if depth < 64 else [64]

    def levels(x):
        nodes = [np.unique(x >> np.uint64(64 - d)) if d else np.zeros(1, np.uint64) for d in depths]
        kids = []
        for up, down, d, e in zip(nodes, nodes[1:], depths, depths[1:]):
            parent = down >> np.uint64(e - d) if d else np.zeros(len(down), np.uint64)
            kids.append((np.searchsorted(parent, up, "left"), np.searchsorted(parent, up, "right")))
        return nodes, kids

    na, ka = levels(a)
    nb, kb = (na, ka) if same else levels(b)
    label = np.arange(len(a) + (0 if same else len(b)))
    off = 0 if same else len(a)

    def unite(i, j):
        nonlocal label
        while len(i):
            li, lj = label[i], label[j]
            keep = li != lj
            i, j, li, lj = i[keep], j[keep], li[keep], lj[keep]
            np.minimum.at(label, np.maximum(li, lj), np.minimum(li, lj))
            while (label[label] != label).any():
                label = label[label]

    stack = [(0, np.arange(len(na[0])), np.arange(len(nb[0])))]
    while stack:
        at, i, j = stack.pop()
        if at == len(depths) - 1:
            unite(i, j + off)
            continue
        wide = ka[at][1][i] - ka[at][0][i]
        total = wide * (kb[at][1][j] - kb[at][0][j])
        ends = np.cumsum(total)
        if ends[-1] > frontier and len(i) > 1:
            cut = min(max(1, int(np.searchsorted(ends, ends[-1] // 2))), len(i) - 1)
            stack += [(at, i[:cut], j[:cut]), (at, i[cut:], j[cut:])]
            continue
        pos = np.arange(ends[-1]) - np.repeat(ends - total, total)
        w = np.repeat(wide, total)
        ci, cj = np.repeat(ka[at][0][i], total) + pos % w, np.repeat(kb[at][0][j], total) + pos // w
        d = depths[at + 1]
        off_bits = np.bitwise_count(na[at + 1][ci] ^ nb[at + 1][cj])
        keep = off_bits <= _budget(d, max_bits)
        if same:
            keep &= (ci < cj) if d == 64 else (ci <= cj)
        if keep.any():
            stack.append((at + 1, ci[keep], cj[keep]))
    members = a if same else np.concatenate([a, b])
    linked = np.flatnonzero(label != np.arange(len(label)))
    return list(zip(members[linked].tolist(), members[label[linked]].tolist()))


def _prefix(col, depth: int):
    return F.lit(0).cast("long") if depth == 0 else F.shiftrightunsigned(col, 64 - depth)


def _node_pairs(reps: DataFrame, n: int, max_bits: int, node_limit: int) -> list[tuple[int, DataFrame]]:
    """Node pairs (a, b; a <= b) by depth that are left to the tasks: at each
    depth those whose nodes are both small enough."""
    half = max_bits // 2
    depth = min(24, max(0, (n * 2 // node_limit).bit_length()))
    nodes = stage_table(reps.groupBy(_prefix(F.col("r"), depth).alias("a")).agg(F.count(F.lit(1)).alias("ca")))
    # the walk's first `depth` levels at once: every node within the budget of a node
    masks = [0]
    for _ in range(half):
        masks += [m ^ (1 << k) for m in masks for k in range(depth)]
    masks = sorted(set(masks))
    other = nodes.select(F.col("a").alias("b"), F.col("ca").alias("cb"))
    pairs = (nodes.select("a", "ca", F.explode(F.array(*[F.col("a").bitwiseXOR(F.lit(m).cast("long")) for m in masks]))
                          .alias("b"))
             .where("a <= b").join(other, "b"))
    done = []
    while True:
        pairs = stage_table(pairs.select("a", "b", "ca", "cb"))
        big = (F.greatest("ca", "cb") > node_limit) if depth < 64 else F.lit(False)
        done.append((depth, pairs.where(~big).select("a", "b")))
        crowded = pairs.where(big)
        if depth == 64 or crowded.isEmpty():
            return done
        step = min(STEP, 64 - depth)
        depth += step
        kids = stage_table(reps.groupBy(_prefix(F.col("r"), depth).alias("kid")).agg(F.count(F.lit(1)).alias("c"))
                           .withColumn("up", F.shiftrightunsigned("kid", step)))
        left = kids.select(F.col("up").alias("a"), F.col("kid").alias("ka"), F.col("c").alias("ca"))
        right = kids.select(F.col("up").alias("b"), F.col("kid").alias("kb"), F.col("c").alias("cb"))
        pairs = (crowded.select("a", "b").join(left, "a").join(right, "b")
                 .where((F.col("ka") <= F.col("kb"))
                        & (F.bit_count(F.col("ka").bitwiseXOR(F.col("kb"))) <= _budget(depth, max_bits)))
                 .select(F.col("ka").alias("a"), F.col("kb").alias("b"), "ca", "cb"))


def _walk(depth: int, swapped: bool, max_bits: int):
    """The task of one node pair: its forest edges, turned back."""
    def walk(key, g):
        r, node = g["r"].to_numpy(np.int64).view(np.uint64), g["node"]
        lists = [np.sort(r[(node == k).to_numpy()]) for k in dict.fromkeys(key)]
        edges = np.array(trie_forest(lists[0], lists[1] if len(lists) > 1 else None, depth, max_bits),
                         np.uint64).reshape(-1, 2)
        if swapped:
            edges = (edges << np.uint64(32)) | (edges >> np.uint64(32))
        return pd.DataFrame(np.ascontiguousarray(edges).view(np.int64), columns=["u", "v"])
    return walk


def links(reps: DataFrame, n: int, max_bits: int = MAX_BITS, node_limit: int = NODE_LIMIT) -> DataFrame:
    """Forest edges (u, v) over distinct fingerprints ``reps`` (fp; ``n`` of
    them) that joins exactly the fingerprints within ``max_bits`` bits."""
    importable(reps.sparkSession)
    out = None
    halves = F.shiftleft("fp", 32).bitwiseOR(F.shiftrightunsigned("fp", 32))
    for swapped in (False, True):
        turned = reps.select((halves if swapped else F.col("fp")).alias("r"))
        for depth, pairs in _node_pairs(turned, n, max_bits, node_limit):
            sides = pairs.select("a", "b", F.explode(F.when(F.col("a") == F.col("b"), F.array("a"))
                                                     .otherwise(F.array("a", "b"))).alias("node"))
            members = sides.join(turned.select(_prefix(F.col("r"), depth).alias("node"), "r"), "node")

            found = members.groupBy("a", "b").applyInPandas(_walk(depth, swapped, max_bits), "u long, v long")
            out = found if out is None else out.union(found)
    return out


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, seed: int = SEED,
                    node_limit: int = NODE_LIMIT) -> DataFrame:
    """One row per document: doc_id, fp (long), component_id (the smallest
    doc_id reachable by links of at most ``max_bits`` differing bits)."""
    fps = stage_table(fingerprints(docs, shingle, seed))
    reps = stage_table(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    comp = connected_components(links(reps.select("fp"), reps.count(), max_bits, node_limit))
    named = reps.join(comp, reps.fp == comp.id, "left").select(
        "fp", "rep", F.coalesce("root", "fp").alias("root"))
    named = stage_table(named)
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    return fps.join(named.join(least, "root").select("fp", "component_id"), "fp").select(
        "doc_id", "fp", "component_id")


def fingerprint_hex(col) -> "F.Column":
    return F.lpad(F.lower(F.hex(col)), 16, "0")


def query(spark, sf_dir: str) -> DataFrame:
    """op5: contract columns over all documents."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the smallest doc_id of each component stays (of repeated
    rows of that id all stay; rows without an id stay)."""
    keep = near_duplicates(docs).where("doc_id = component_id").select(F.col("doc_id").alias("kept")).distinct()
    keep = keep.union(spark.range(1).select(F.lit(None).cast("long")))
    d = docs.select(*DOCUMENT_COLUMNS)
    return d.join(keep, d.doc_id.eqNullSafe(keep.kept), "left_semi")
