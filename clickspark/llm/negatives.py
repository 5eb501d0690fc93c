"""Hard-negative mining over embeddings by a secondary-sort shuffle.

A row's score is its integer inner product with the anchor.  An anchor's
positives are its first rows of the same label by (descending score, id); for
each positive, its hard negatives are the first rows of other labels whose
score lies in a window below the positive's.

Every scored pair is packed into one key (anchor, descending score, positive
before negative, id) whose bytes sort in that order.  The keys are shuffled by
anchor and sorted within their partitions (``repartition`` +
``sortWithinPartitions``, the frame form of repartitionAndSortWithinPartitions);
one iterator runs down a partition, opens a window at each positive, emits the
negatives that come by while it is open, and closes it when it is full or the
score has left it.  It holds an anchor's open windows and nothing else.

Scale: pairs are scored in blocks (``BLOCK`` rows against ``ANCHORS`` anchors, one
matrix product), anchors being the stated queries.  Of a block pair only what
can be among the first is emitted: first the block's first positives of each
anchor; then, once the positives and so the windows are known, the block's
first negatives of each window.  So the shuffle holds a few keys per block and
anchor, whatever the labels' sizes, and is exact.  The packed anchors are
broadcast where their measured size is below ``BROADCAST`` bytes; beyond it
they are joined to lanes of row blocks, so that a task streams blocks past one
another.

Scores are exact: the product runs in doubles where it stays below 2^53, in
integers elsewhere; scores beyond a long are held at its ends.

Rows: null label, null vector, or a null or non-finite component: no part.
Vectors of unequal lengths: the shorter is filled with zeros.  Rows equal in
id, label and vector are one row; rows that share an id but differ are rows of
their own.  Null ids come after all others in ties and are returned as null.
Very long vectors make blocks of few rows.  Extra columns are ignored; an empty
table gives an empty result."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from clickspark.llm.common import importable, map_rows, table
from clickspark.staging import stage_table

#: Rows and anchors of a block pair; vector components of a block at most (unless one row has more).
BLOCK, ANCHORS, VALUES = 4096, 512, 1 << 19
#: Bytes of packed anchors that may be broadcast; row blocks that share a lane beyond that.
BROADCAST, LANE = 8 << 20, 4

_LONG = np.iinfo(np.int64)
#: anchor, its id; score descending, kind, id, row: big-endian, so that bytes sort like the values.
_KEY = np.dtype([("anchor", ">u8"), ("anchor_null", "u1"), ("anchor_id", ">u8"), ("score", ">u8"), ("kind", "u1"),
                 ("null", "u1"), ("id", ">u8"), ("row", ">u8")])
_SIGN = np.uint64(1 << 63)
_PACKED = ("block long, n int, dim int, rows binary, ids binary, nulls binary, labels binary, vectors binary, "
           "asked binary, windows binary")
_ROWS = "row long, vec_id long, label long, vector array<long>"


def _up(x) -> np.ndarray:
    """Signed to unsigned longs of the same order."""
    return np.asarray(x, np.int64).view(np.uint64) ^ _SIGN


def _down(x) -> np.ndarray:
    return (np.asarray(x, np.uint64) ^ _SIGN).view(np.int64)


def quantised(df: DataFrame, scale: int = 256, vector: str = "embedding") -> DataFrame:
    """vec_id, label, vector (longs: floor(scale * component)) of the rows that
    take part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.col("label").isNotNull() & F.col(vector).isNotNull() & ~bad).select(
        "vec_id", F.col("label").cast("long").alias("label"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale)))).alias("vector"))


def _arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` where ``fn`` yields lists of column values."""
    importable(df.sparkSession)
    schema = StructType.fromDDL(schema)
    arrow = to_arrow_schema(schema)

    def run(batches):
        for cols in fn(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def _numbers(column, missing=0) -> np.ndarray:
    return column.fill_null(missing).to_numpy(zero_copy_only=False).astype(np.int64)


def packed(rows: DataFrame, limit: int) -> DataFrame:
    """Blocks of at most ``limit`` rows as arrays in binary columns.  ``row``
    numbers a row (made here where there is none), ``asked`` marks anchors,
    ``windows`` holds the scores that open an anchor's windows."""
    has = set(rows.columns)
    wanted = ["vec_id", "label", "vector"] + [c for c in ("row", "asked", "windows") if c in has]

    def pack(batches):
        task, seq = TaskContext.get().partitionId(), 0
        for b in batches:
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            n = b.num_rows
            vectors = col["vector"]
            ends = np.concatenate([[0], np.cumsum(np.diff(vectors.offsets.to_numpy()))])
            values = vectors.flatten().to_numpy(zero_copy_only=False)
            size = np.diff(ends)
            i = 0
            while i < n:
                j = i + 1
                width = max(1, size[i])
                while j < n and j - i < limit and max(width, size[j]) * (j - i + 1) <= VALUES:
                    width, j = max(width, size[j]), j + 1
                m = np.zeros((j - i, width), np.int64)
                if (size[i:j] == width).all():
                    m[:] = values[ends[i]:ends[j]].reshape(j - i, width)
                else:
                    for r in range(i, j):
                        m[r - i, :size[r]] = values[ends[r]:ends[r + 1]]
                # narrow where the values allow it
                kind = next(t for t in (np.int16, np.int32, np.int64)
                            if m.min() >= np.iinfo(t).min and m.max() <= np.iinfo(t).max)
                block = task << 24 | seq
                rows_ = _numbers(col["row"])[i:j] if "row" in col else (block << 13) + np.arange(j - i)
                asked = windows = b""
                if "asked" in col:
                    asked = np.asarray(col["asked"].to_numpy(zero_copy_only=False)[i:j], np.uint8).tobytes()
                if "windows" in col:  # the least long where there are fewer
                    lists = col["windows"].slice(i, j - i).to_pylist()
                    k = max(1, max(len(x or []) for x in lists))
                    windows = np.array([(x or []) + [_LONG.min] * (k - len(x or [])) for x in lists], np.int64).tobytes()
                yield ([block], [j - i], [width], [rows_.astype(np.int64).tobytes()],
                       [_numbers(col["vec_id"])[i:j].tobytes()],
                       [np.asarray(col["vec_id"].is_null().to_numpy(zero_copy_only=False)[i:j], np.uint8).tobytes()],
                       [_numbers(col["label"])[i:j].tobytes()], [np.dtype(kind).char.encode() + m.astype(kind).tobytes()],
                       [asked], [windows])
                seq, i = seq + 1, j

    return _arrow(rows.select(*wanted), pack, _PACKED)


class _Block:
    """A packed block, read back."""

    def __init__(self, r: dict, p: str):
        n = r[p + "n"]
        self.row = np.frombuffer(r[p + "rows"], np.int64)
        self.id = np.frombuffer(r[p + "ids"], np.int64)
        self.null = np.frombuffer(r[p + "nulls"], np.uint8)
        self.label = np.frombuffer(r[p + "labels"], np.int64)
        v = r[p + "vectors"]
        self.vector = np.frombuffer(v, np.dtype(chr(v[0])), offset=1).reshape(n, r[p + "dim"])
        w = r[p + "windows"]
        self.windows = np.frombuffer(w, np.int64).reshape(n, -1) if w else np.empty((n, 0), np.int64)

    def ordered(self) -> "_Block":
        """With its rows by (id, nulls last, row)."""
        o = np.lexsort((self.row, self.id, self.null))
        for name in ("row", "id", "null", "label", "vector", "windows"):
            setattr(self, name, getattr(self, name)[o])
        return self


def asked(blocks: DataFrame) -> DataFrame:
    """The anchors of packed blocks, one row each."""

    def unpack(batches):
        for b in batches:
            for i in range(b.num_rows):
                r = {n: b.column(c)[i].as_py() for c, n in enumerate(b.schema.names)}
                k, at = _Block(r, ""), np.flatnonzero(np.frombuffer(r["asked"], np.uint8))
                if len(at):
                    yield (k.row[at], [None if k.null[j] else int(k.id[j]) for j in at], k.label[at],
                           list(k.vector[at].astype(np.int64)))

    return _arrow(blocks, unpack, _ROWS)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of ``a`` and ``b``, shorter rows filled with
    zeros, as longs."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = [max(-int(x.min()), int(x.max())) for x in (a, b)]
    if most[0] * most[1] * d < 1 << 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    s = a.astype(object) @ b.astype(object).T
    return np.clip(s, _LONG.min, _LONG.max).astype(np.int64)


def first_positives(rows: _Block, anchors: _Block, k: int):
    """(row, anchor, score) of the block's first ``k`` same-label rows of each
    anchor."""
    for label in np.unique(anchors.label):
        at, of = np.flatnonzero(rows.label == label), np.flatnonzero(anchors.label == label)
        if not len(at):
            continue
        s = scores(rows.vector[at], anchors.vector[of])
        for c, j in enumerate(of):
            x = s[:, c]
            own = rows.row[at] == anchors.row[j]
            if len(x) > k + 1:  # the k-th score and all its ties, one more for the anchor itself
                near = np.flatnonzero(x >= np.partition(x, len(x) - k - 1)[len(x) - k - 1])
                near = near[~own[near]]
            else:
                near = np.flatnonzero(~own)
            near = near[np.argsort(-x[near], kind="stable")[:k]]
            yield at[near], np.full(len(near), j), x[near]


def first_negatives(rows: _Block, anchors: _Block, k: int, low: int, high: int):
    """(row, anchor, score) of the block's first ``k`` other-label rows in each
    window of each anchor: low * p <= high * score <= high * p."""
    if not anchors.windows.shape[1]:
        return
    s = scores(rows.vector, anchors.vector)
    for j in range(len(anchors.row)):
        tops = sorted({int(p) for p in anchors.windows[j] if p >= 0}, reverse=True)
        if not tops:
            continue
        floor = [-(-low * p // high) for p in tops]
        x = s[:, j]
        at = np.flatnonzero((x <= tops[0]) & (x >= min(floor)) & (rows.label != anchors.label[j]))
        if not len(at):
            continue
        at = at[np.argsort(-x[at], kind="stable")]
        y = -x[at]
        keep = np.zeros(len(at), bool)
        for p, f in zip(tops, floor):
            a = np.searchsorted(y, -p)
            keep[a:min(a + k, np.searchsorted(y, -f, "right"))] = True
        yield at[keep], np.full(int(keep.sum()), j), x[at[keep]]


def _keys(rows: _Block, anchors: _Block, kind: int, found) -> np.ndarray | None:
    found = [f for f in found if len(f[0])]
    if not found:
        return None
    r, a, s = (np.concatenate(x) for x in zip(*found))
    out = np.zeros(len(r), _KEY)
    out["anchor"], out["anchor_null"], out["anchor_id"] = _up(anchors.row[a]), anchors.null[a], _up(anchors.id[a])
    out["score"], out["kind"] = ~_up(s), kind
    out["null"], out["id"], out["row"] = rows.null[r], _up(rows.id[r]), _up(rows.row[r])
    return out


_KEYS = "anchor long, key binary"


def pairs(rows: DataFrame, anchors: DataFrame, kind: int, pick) -> DataFrame:
    """Keys that ``pick(rows, anchors)`` takes of every block pair."""
    size = anchors.agg(F.sum(F.length("vectors") + F.length("windows") + 25 * F.col("n"))).first()[0] or 0
    lanes = max(1, -(-rows.count() // LANE))
    small = size <= BROADCAST
    lanes, left = (1, rows.repartition(lanes)) if small else (lanes, rows)
    left = left.withColumn("lane", F.pmod(F.xxhash64("block"), F.lit(lanes)).cast("int"))
    right = anchors.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    right = F.broadcast(right) if small else right.hint("merge")
    names = [x.split()[0] for x in _PACKED.split(", ")]
    both = left.join(right.select("lane", *(F.col(c).alias("a_" + c) for c in names)), "lane").drop("lane")

    def score(batches):
        for b in batches:
            old = None
            for i in range(b.num_rows):
                r = {n: b.column(c)[i].as_py() for c, n in enumerate(b.schema.names)}
                if old is None or old[0] != r["block"]:
                    old = r["block"], _Block(r, "").ordered()
                mine, other = old[1], _Block(r, "a_")
                keys = _keys(mine, other, kind, pick(mine, other))
                if keys is not None:
                    yield [_down(keys["anchor"].astype(np.uint64)), list(keys.view(f"V{_KEY.itemsize}").tolist())]

    return _arrow(both, score, _KEYS)


def _sorted(keys: DataFrame) -> DataFrame:
    return keys.repartition("anchor").sortWithinPartitions("key").select("key")


def _read(batches):
    """(anchor, anchor_id, score, kind, id) in order, from sorted keys."""
    for b in batches:
        k = np.frombuffer(b"".join(b["key"]), _KEY)
        cols = [_down(k[n].astype(np.uint64)).tolist() for n in ("anchor", "anchor_id", "id")]
        score = _down(~k["score"].astype(np.uint64)).tolist()
        for a, an, ai, s, kind, null, i in zip(cols[0], k["anchor_null"].tolist(), cols[1], score, k["kind"].tolist(),
                                               k["null"].tolist(), cols[2]):
            yield a, None if an else ai, s, kind, None if null else i


def _emit(names, rows, size=8192):
    out = []
    for r in rows:
        out.append(r)
        if len(out) >= size:
            yield dict(zip(names, map(list, zip(*out))))
            out = []
    yield dict(zip(names, map(list, zip(*out)))) if out else {n: [] for n in names}


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80,
                   high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score; ``rows``: vec_id, label, vector (longs); ``is_anchor`` says
    which rows are anchors.  A negative counts where
    low * positive_score <= high * negative_score <= high * positive_score."""
    items = rows.select("vec_id", "label", "vector", F.coalesce(is_anchor, F.lit(False)).alias("asked")).distinct()
    blocks = stage_table(packed(items, BLOCK))
    numbered = stage_table(asked(blocks))
    n = max(1, -(-numbered.count() // ANCHORS))
    anchors = stage_table(packed(numbered.repartition(n), ANCHORS))

    near = stage_table(pairs(blocks, anchors, 0, lambda r, a: first_positives(r, a, positives)))

    def first(batches):
        def out():
            now, scores_ = None, []
            for a, _, s, _, _ in _read(batches):
                if a != now:
                    if now is not None:
                        yield now, scores_
                    now, scores_ = a, []
                if len(scores_) < positives:
                    scores_.append(s)
            if now is not None:
                yield now, scores_

        yield from _emit(["row", "windows"], out())

    windows = map_rows(_sorted(near), first, "row long, windows array<long>")
    opened = stage_table(packed(numbered.join(windows, "row").repartition(n), ANCHORS))
    far = pairs(blocks, opened, 1, lambda r, a: first_negatives(r, a, negatives, low, high))

    def run(batches):
        def out():
            now, opens, met = None, [], 0
            for a, anchor, s, kind, i in _read(batches):
                if a != now:
                    now, opens, met = a, [], 0
                if kind == 0:
                    if met < positives:
                        met += 1
                        opens.append([i, s, 0])
                    continue
                opens = [w for w in opens if w[2] < negatives and low * w[1] <= high * s]
                for w in opens:
                    if s <= w[1]:
                        w[2] += 1
                        yield anchor, w[0], w[2], i, w[1], s

        yield from _emit(["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"], out())

    return map_rows(_sorted(near.union(far)), run,
                    "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def query(spark, sf_dir: str) -> DataFrame:
    """op11: hard negatives of every anchor of ``embeddings``."""
    rows = quantised(table(spark, sf_dir, "embeddings"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)
