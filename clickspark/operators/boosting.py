"""Gradient-boosted trees with second-order gain, grown level by level or
best-first, and their exact attribution.

Training data is binned once (at most ``max_bins`` bins a feature, cut at values
that occur and placed by the ranks of all rows) and packed into blocks of rows.  A tree is grown from histograms:
each level is one job in which every task adds up gradients, hessians and rows
per (node, feature, bin) over its blocks; the features are dealt out to tasks that
add up the cells and find the best split of every open node.  The driver sees one
split per open node and feature, neither rows nor cells.  Blocks are held in as
many partitions as the cluster has cores at most, so what is shuffled does not
grow with the rows beyond that.  Several models are grown side by side: a job
does the same level of all of them, each on rows and bins of its own, and a
model's blocks lie next to each other, so few tasks send cells of it.  Gradients are whole numbers of 2^-32, so sums,
and with them trees, do not depend on the partitioning.

A split's gain is ``GL^2/(HL+l2) + GR^2/(HR+l2) - G^2/(H+l2)``, a leaf's value
``-rate * G/(H+l2)``.  With ``leaves`` the tree is best-first: of all splits those
with the greatest gains are kept as a queue of leaves would pop them.  A split
is popped before another if the least gain on its path is greater, so a level
only opens nodes among the first ``leaves - 1`` so far.  Missing values go left.

Margins are kept with the blocks, moved on by each tree once it is grown and
written anew every ``RESTAGE`` trees, so a lost executor costs at most that many
trees of re-scoring."""

from __future__ import annotations

import functools
import heapq
import itertools
import math
import operator
from collections.abc import Generator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickspark.schema import FEATURE_COLS
from clickspark.staging import stage_table

#: Rows of a block; trees between two writings of the margins.
BLOCK, RESTAGE = 65_536, 16
_UNIT = float(2 ** 32)
_BINS = 256
#: ``fit`` numbers the models grown side by side, ``slot`` is the block's partition.
_BLOCK = "bins binary, labels binary, margins binary, fit int, slot int"


@dataclass
class Tree:
    """Nodes as arrays; a leaf has feature -1.  ``rows`` and ``cover`` (sum of
    hessians) count training rows."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    gain: list[float] = field(default_factory=lambda: [0.0])
    sums: list[tuple[int, int, int]] = field(default_factory=lambda: [(0, 0, 0)])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, threshold: float, gain: float, left, right) -> tuple[int, int]:
        a = len(self.feature)
        self.feature[node], self.cut[node], self.threshold[node], self.gain[node] = feature, cut, threshold, gain
        self.left[node], self.right[node] = a, a + 1
        for sums in (left, right):
            self.feature.append(-1)
            self.cut.append(0)
            self.threshold.append(0.0)
            self.left.append(-1)
            self.right.append(-1)
            self.gain.append(0.0)
            self.sums.append(sums)
            self.value.append(0.0)
        return a, a + 1

    def leaves_of(self, x: np.ndarray, binned: bool) -> np.ndarray:
        """The leaf of every row: ``x`` holds bins, or values (NaN goes left)."""
        at = np.zeros(len(x), np.int64)
        f = np.array(self.feature)
        leaf = f < 0
        own = np.arange(len(f))                         # a leaf leads to itself
        kids = np.column_stack([np.where(leaf, own, v) for v in (self.left, self.right)]).ravel()
        cut, of = np.array(self.cut if binned else self.threshold), np.maximum(f, 0) * len(x)
        rows, flat = np.arange(len(x)), x.ravel("F")    # of bins a view: a column of them lies together
        while not leaf[at].all():
            at = kids[2 * at + (flat[of[at] + rows] > cut[at])]
        return at

    def kept(self, wanted: set[int]) -> "Tree":
        """The tree whose only splits are the nodes ``wanted``."""
        out, todo = Tree(), [(0, 0)]
        out.sums[0] = self.sums[0]
        while todo:
            old, new = todo.pop(0)
            if old in wanted:
                a, b = self.left[old], self.right[old]
                x, y = out.split(new, self.feature[old], self.cut[old], self.threshold[old], self.gain[old],
                                 self.sums[a], self.sums[b])
                todo += [(a, x), (b, y)]
        return out


class BoostedTrees:
    """A fitted model: ``base`` margin, trees, feature names."""

    def __init__(self, features: Sequence[str], base: float, trees: list[Tree]):
        self.features, self.base, self.trees = list(features), base, trees

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += np.array(t.value)[t.leaves_of(x, False)]
        return out

    def predict(self, df: DataFrame, out: str = "score") -> DataFrame:
        """``df`` with the positive-class probability, scored in Arrow batches."""
        return df.withColumn(out, self._scored()(*[F.col(c).cast("double") for c in self.features]))

    def _scored(self):
        model = self

        @F.pandas_udf("double")
        def score(*cols: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(float, na_value=np.nan) for c in cols])
            return pd.Series(1 / (1 + np.exp(-model.margins(x))))

        return score

    def nodes(self, spark) -> DataFrame:
        """One row per node: tree, node, feature (null in leaves), threshold,
        left, right, gain, cover, rows, value."""
        rows = []
        for i, t in enumerate(self.trees):
            for n, f in enumerate(t.feature):
                inner = f >= 0
                rows.append((i, n, self.features[f] if inner else None, t.threshold[n] if inner else None,
                             t.left[n] if inner else None, t.right[n] if inner else None, t.gain[n] if inner else None,
                             t.sums[n][1] / _UNIT, t.sums[n][2], None if inner else t.value[n]))
        return spark.createDataFrame(rows, "tree int, node int, feature string, threshold double, left int, right int, "
                                           "gain double, cover double, rows long, value double")

    def attributions(self, df: DataFrame, key: str = "user_id") -> DataFrame:
        """Exact Shapley values of the margin per row: key, idx, phi.  The value
        of a set of features is the mean margin when the others follow the
        trees' covers; ``expected`` is that of no feature."""
        model = self

        def run(batches):
            for b in batches:
                x = np.column_stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in b.columns[1:]])
                phi, d = model.shapley(x), len(model.features)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), d))),
                     pa.array(np.tile(np.arange(d, dtype=np.int32), b.num_rows)), pa.array(phi.ravel())],
                    names=[key, "idx", "phi"])

        kind = dict(df.dtypes)[key]
        return df.select(key, *[F.col(c).cast("double").alias(c) for c in self.features]).mapInArrow(
            run, f"{key} {kind}, idx int, phi double")

    def expected(self) -> float:
        return self.base + sum(_mean(t, 0) for t in self.trees)

    def shapley(self, x: np.ndarray) -> np.ndarray:
        """Shapley values (rows x features) by paths: a leaf's value is a product
        over the features of its path, so a feature's share is a sum over the
        sizes of the sets of the others; polynomial in the path's length."""
        out = np.zeros(x.shape)
        for t in self.trees:
            for leaf, path in _paths(t):
                names = sorted({f for f, *_ in path})
                m, v = len(names), t.value[leaf]
                if not m or v == 0:
                    continue
                one, zero = [], []
                for f in names:
                    ok, z = np.ones(len(x), bool), 1.0
                    for g, thr, side, share in path:
                        if g == f:
                            ok &= (x[:, f] > thr) == bool(side)
                            z *= share
                    one.append(ok.astype(float))
                    zero.append(z)
                for j, f in enumerate(names):
                    # coefficients by number of present features among the others
                    poly = [np.ones(len(x))]
                    for k in range(m):
                        if k != j:
                            grown = [p * zero[k] for p in poly] + [np.zeros(len(x))]
                            for s, p in enumerate(poly):
                                grown[s + 1] = grown[s + 1] + p * one[k]
                            poly = grown
                    share = sum(p * (math.factorial(s) * math.factorial(m - 1 - s) / math.factorial(m)) for s, p in enumerate(poly))
                    out[:, f] += v * (one[j] - zero[j]) * share
        return out


def _mean(t: Tree, node: int) -> float:
    if t.feature[node] < 0:
        return t.value[node]
    total = t.sums[node][1]
    return sum(t.sums[c][1] / total * _mean(t, c) for c in (t.left[node], t.right[node]))


def _paths(t: Tree):
    """(leaf, [(feature, threshold, 1 if right, share of the cover)]) of every leaf."""
    todo = [(0, [])]
    while todo:
        node, path = todo.pop()
        if t.feature[node] < 0:
            yield node, path
            continue
        for side, c in enumerate((t.left[node], t.right[node])):
            todo.append((c, path + [(t.feature[node], t.threshold[node], side, t.sums[c][1] / t.sums[node][1])]))


def bin_edges(df: DataFrame, features: Sequence[str], max_bins: int) -> list[np.ndarray]:
    """Cut values per feature: all different values but the greatest where
    ``max_bins`` hold them, else the values at ranks ceil(i * n / max_bins);
    of all rows, whatever their number.  Missing values have no rank."""
    return bin_edges_for(df, features, [max_bins])[max_bins]


def bin_edges_for(df: DataFrame, features: Sequence[str], bins: Sequence[int]) -> dict[int, list[np.ndarray]]:
    """``bin_edges`` for several numbers of bins at once.

    The different values are counted, range-partitioned and given running counts
    from per-partition offsets; only the cut values come to the driver."""
    whole = Window.partitionBy("f")
    stacked = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).cast("double").alias("v"))
                                  for i, c in enumerate(features)])).alias("_s")
    values = df.select(stacked).select("_s.f", "_s.v").where(F.col("v").isNotNull() & ~F.isnan("v"))
    counts = values.groupBy("f", "v").agg(F.count(F.lit(1)).alias("c"))
    t = stage_table(counts.repartitionByRange("f", "v").withColumn("_pid", F.spark_partition_id()))
    part = t.groupBy("f", "_pid").agg(F.sum("c").alias("_c"), F.count(F.lit(1)).alias("_d"), F.max("v").alias("_top"))
    earlier = whole.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition and feature
    offs = part.select("f", "_pid", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("off"),
                       F.sum("_c").over(whole).alias("n"), F.sum("_d").over(whole).alias("d"), F.max("_top").over(whole).alias("top"))
    running = Window.partitionBy("f", "_pid").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = t.join(F.broadcast(offs), ["f", "_pid"]).withColumn("upto", F.col("off") + F.sum("c").over(running))
    # of the ranks ceil(i * n / m), 0 < i < m, those up to x are the first x * m div n
    cuts = [F.expr(f"d <= {m} OR least(upto * {m} div n, {m - 1}) > (upto - c) * {m} div n").alias(f"cut{m}") for m in bins]
    held = ranked.where(F.col("v") < F.col("top")).select("f", "v", *cuts)
    rows = held.where(functools.reduce(operator.or_, [F.col(f"cut{m}") for m in bins])).collect()
    return {m: [np.array(sorted(r["v"] for r in rows if r["f"] == f and r[f"cut{m}"]), float) for f in range(len(features))]
            for m in bins}


def _pack(df: DataFrame, features: Sequence[str], label: str, edges: list[np.ndarray], base: float, fit: int = 0,
          start: int = 0, of: int = 1, parts: int = 1) -> DataFrame:
    """Blocks of ``df`` for the model ``fit``.  Partition p of ``df`` is share
    ``start + p`` of ``of`` shares of all models, dealt in order to ``parts`` slots."""
    def run(batches):
        slot = (start + TaskContext.get().partitionId()) * parts // of
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                part = b.slice(i, BLOCK)
                cols = []
                for c, e in zip(part.columns[1:], edges):
                    v = c.to_numpy(zero_copy_only=False)
                    cols.append(np.where(np.isnan(v), 0, np.searchsorted(e, v, "left")).astype(np.uint8))
                y = part.column(0).to_numpy(zero_copy_only=False).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([np.stack(cols).tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary()),
                     pa.array([np.full(len(y), base).tobytes()], pa.binary()), pa.array([fit], pa.int32()),
                     pa.array([slot], pa.int32())], names=["bins", "labels", "margins", "fit", "slot"])

    return df.select(F.col(label).cast("int").alias("y"), *[F.col(c).cast("double").alias(c) for c in features]).mapInArrow(
        run, _BLOCK)


def _arrays(block, d: int):
    """Bins (a column of them lies together), labels and margins."""
    bins, labels, margins, *_ = block
    return np.frombuffer(bins, np.uint8).reshape(d, -1).T, np.frombuffer(labels, np.uint8), np.frombuffer(margins, float)


def _kept(blocks: DataFrame, parts: int | None = None):
    """Staged blocks by their slots as an RDD that stays in memory: a level is
    one small job, so it should not be planned anew each time."""
    parts = parts or blocks.sparkSession.sparkContext.defaultParallelism
    return (blocks.rdd.map(lambda b: (b[4], tuple(b))).partitionBy(parts, lambda slot: slot).values()
            .persist(StorageLevel.MEMORY_AND_DISK))


def _advanced(blocks, d: int, trees: dict[int, Tree]):
    """The blocks with margins moved on by the model's tree in ``trees``."""
    value = {i: np.array(t.value) for i, t in trees.items()}

    def step(b):
        if b[3] not in trees:
            return b
        bins, _, margins = _arrays(b, d)
        return b[0], b[1], (margins + value[b[3]][trees[b[3]].leaves_of(bins, True)]).tobytes(), *b[3:]

    return blocks.map(step)


def _sums(part, d: int, tree: Tree, nodes: list[int], widths: list[int]):
    """Per feature the sums of gradient, hessian and rows over a model's blocks,
    as one array (sum, node, bin)."""
    slot = np.full(len(tree.feature), -1)
    slot[nodes] = range(len(nodes))
    sums = [np.zeros((3, len(nodes) * w), np.int64) for w in widths]
    for b in part:
        bins, y, margins = _arrays(b, d)
        at = slot[tree.leaves_of(bins, True)]
        rows = np.flatnonzero(at >= 0)
        if not len(rows):
            continue
        if len(rows) == len(at):
            rows = slice(None)
        at, p = at[rows], 1 / (1 + np.exp(-margins[rows]))
        parts = np.rint((p - y[rows]) * _UNIT), np.rint(p * (1 - p) * _UNIT), None
        first = {w: at * w for w in set(widths)}
        for f, w in enumerate(widths):
            cell = first[w] + bins[rows, f]
            for k, weight in enumerate(parts):
                sums[f][k] += np.bincount(cell, weight, len(nodes) * w).astype(np.int64)
    for f, w in enumerate(widths):
        yield f, sums[f].reshape(3, len(nodes), w)


@dataclass
class Level:
    """What a model asks of a level: the best splits of ``nodes`` of ``tree``."""

    tree: Tree
    nodes: list[int]
    edges: list[np.ndarray]
    l2: float
    least_h: float
    least_rows: int


def _level(blocks, d: int, asked: dict[int, Level]) -> dict[int, tuple[tuple[int, int, int], list]]:
    """Per model of ``asked`` the sums over all rows of its nodes, and per node
    the best split (``_best``, with its feature): the first by feature and bin of
    equal ones.  One job."""
    adders = max(1, min(d * len(asked), blocks.getNumPartitions()))
    number = {i: k for k, i in enumerate(asked)}
    # tasks need the number of bins, not where they are cut
    tasks = {i: (a.tree, a.nodes, [len(e) + 1 for e in a.edges]) for i, a in asked.items()}
    rules = {i: (a.l2, a.least_h, a.least_rows) for i, a in asked.items()}

    def cells(part):
        added: dict[tuple[int, int], np.ndarray] = {}
        for i, own in itertools.groupby(part, key=lambda b: b[3]):
            if i in tasks:
                for f, sums in _sums(own, d, *tasks[i]):
                    added[i, f] = added[i, f] + sums if (i, f) in added else sums
        return iter(added.items())

    def best(part):
        added: dict[tuple[int, int], np.ndarray] = {}
        for key, sums in part:
            added[key] = added[key] + sums if key in added else sums
        for (i, f), hist in added.items():
            total = tuple(int(v) for v in hist.sum((1, 2))) if f == 0 else None
            yield i, f, total, _best(hist, *rules[i])

    dealt = blocks.mapPartitions(cells).partitionBy(adders, lambda key: number[key[0]] * d + key[1])
    out = {i: ((0, 0, 0), [None] * len(a.nodes)) for i, a in asked.items()}
    for i, f, whole, splits in sorted(dealt.mapPartitions(best).collect(), key=lambda x: x[:2]):
        total, found = out[i]
        for n, x in enumerate(splits):
            if x is not None and (found[n] is None or x[0] > found[n][0]):
                found[n] = (x[0], f, *x[1:])
        out[i] = (whole or total, found)
    return out


def _splits(blocks, d: int, tree: Tree, nodes: list[int], edges: list[np.ndarray], l2: float, least_h: float,
            least_rows: int) -> tuple[tuple[int, int, int], list]:
    """``_level`` of blocks of one model."""
    return _level(blocks, d, {0: Level(tree, nodes, edges, l2, least_h, least_rows)})[0]


def _best(hist: np.ndarray, l2: float, least_h: float, least_rows: int) -> list:
    """Per node (gain, bin, left sums, right sums) of its best split by one
    feature, the first by bin of equal ones; None where none is allowed."""
    left = np.cumsum(hist, axis=2)
    total = left[:, :, -1:]
    right = total - left
    (gl, hl, _), (gr, hr, _), (g, h, _) = left / _UNIT, right / _UNIT, total / _UNIT
    nl, nr = left[2], right[2]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = gl * gl / (hl + l2) + gr * gr / (hr + l2) - g * g / (h + l2)
    ok = (nl >= max(1, least_rows)) & (nr >= max(1, least_rows)) & (hl >= least_h) & (hr >= least_h)
    gain = np.where(ok, gain, -np.inf)
    out = []
    for n, b in enumerate(np.argmax(gain, axis=1).tolist()):
        x = float(gain[n, b])
        out.append((x, b, tuple(left[:, n, b].tolist()), tuple(right[:, n, b].tolist())) if x > 1e-9 else None)
    return out


def _popped(tree: Tree, splits: int) -> set[int]:
    """The nodes that best-first growth splits: always the open node of
    greatest gain (the first by number of equal ones)."""
    queue, out = [(-tree.gain[0], 0)], set()
    while queue and len(out) < splits:
        _, node = heapq.heappop(queue)
        if tree.feature[node] < 0:
            continue
        out.add(node)
        for c in (tree.left[node], tree.right[node]):
            heapq.heappush(queue, (-tree.gain[c], c))
    return out


def _grow(edges, depth, leaves, l2, least_h, least_rows) -> Generator[Level, tuple, Tree]:
    """A tree; yields what it asks of each level, is sent what ``_level`` found."""
    tree, level, worst = Tree(), [0], {}                # worst: least gain on the path to a split and of it
    above = {0: math.inf}
    for k in range(depth):
        total, splits = yield Level(tree, level, edges, l2, least_h, least_rows)
        if k == 0:
            tree.sums[0] = total
        found = {}
        for node, best in zip(level, splits):
            if best is not None:
                found[node] = best
                worst[node] = min(above[node], best[0])
        if leaves is not None:                          # what a queue of leaves could still pop
            ranked = sorted(worst.values(), reverse=True)[:leaves - 1]
            found = {n: b for n, b in found.items() if ranked and worst[n] >= ranked[-1]}
        level = []
        for node, (gain, f, b, left, right) in found.items():
            for c in tree.split(node, f, b, float(edges[f][b]), gain, left, right):
                above[c] = worst[node]
                level.append(c)
        if not level:
            break
    return tree if leaves is None else tree.kept(_popped(tree, leaves - 1))


def _grown(blocks, d: int, growing: dict[int, Generator]) -> dict[int, Tree]:
    """The next tree of every model, level by level for all of them."""
    out, found = {}, dict.fromkeys(growing)
    while found:
        asked = {}
        for i, answer in found.items():
            try:
                asked[i] = growing[i].send(answer)
            except StopIteration as end:
                out[i] = end.value
        found = _level(blocks, d, asked) if asked else {}
    return out


@dataclass
class Settings:
    """``leaves`` None grows level by level to ``maxDepth``."""

    maxIter: int = 100
    maxDepth: int = 6
    stepSize: float = 0.05
    maxBins: int = 256
    leaves: int | None = None
    l2: float = 1.0
    minHessian: float = 1.0
    minRows: int = 1


def fit_boosted(train: DataFrame, label: str = "label", features: Sequence[str] = FEATURE_COLS, **settings) -> BoostedTrees:
    """Fit on 0/1 labels by the logistic loss; the first margin is the log-odds
    of the label.  ``settings`` as in ``Settings``."""
    return fit_boosted_together([(train, settings)], label, features)[0]


def fit_boosted_together(asked: Sequence[tuple[DataFrame, dict]], label: str = "label",
                         features: Sequence[str] = FEATURE_COLS) -> list[BoostedTrees]:
    """``fit_boosted`` of every (train, settings) side by side: the models are the
    same, a level of all of them is one job."""
    d, spark = len(features), asked[0][0].sparkSession
    models: list[BoostedTrees] = []
    own: dict[int, tuple[DataFrame, Settings, int]] = {}
    frames: dict[int, DataFrame] = {id(train): train for train, _ in asked}  # one may be asked for more than once
    rows = {k: train.agg(F.count(F.lit(1)), F.sum(F.col(label).cast("long"))).first() for k, train in frames.items()}
    for i, (train, settings) in enumerate(asked):
        n, ones = rows[id(train)]
        if not n or ones in (0, n, None):
            models.append(BoostedTrees(features, 0.0 if not n else math.inf if ones == n else -math.inf, []))
        else:
            models.append(BoostedTrees(features, math.log(ones / n / (1 - ones / n)), []))
            own[i] = train, Settings(**settings), -(-n // BLOCK)
    if not own:
        return models
    bins = {i: min(s.maxBins, _BINS) for i, (_, s, _) in own.items()}
    found = {k: bin_edges_for(frames[k], features, sorted({bins[i] for i in own if id(own[i][0]) == k}))
             for k in dict.fromkeys(id(train) for train, *_ in own.values())}
    edges = {i: found[id(train)][bins[i]] for i, (train, *_) in own.items()}
    of = sum(shares for *_, shares in own.values())
    parts, start, packed = min(of, spark.sparkContext.defaultParallelism), 0, []
    for i, (train, _, shares) in own.items():
        packed.append(stage_table(_pack(train.repartition(shares), features, label, edges[i], models[i].base, i, start, of, parts)))
        start += shares
    blocks = _kept(functools.reduce(DataFrame.union, packed), parts)
    before = None                                       # what ``blocks`` come from, until they are in memory
    left = {i: s for i, (_, s, _) in own.items()}       # the models still growing
    try:
        for k in itertools.count(1):
            trees = _grown(blocks, d, {i: _grow(edges[i], s.maxDepth, s.leaves, s.l2, s.minHessian, s.minRows)
                                       for i, s in left.items() if k <= s.maxIter})
            if before is not None:
                before.unpersist()
                before = None
            for i, tree in trees.items():
                for j, (f, (g, h, _)) in enumerate(zip(tree.feature, tree.sums)):
                    tree.value[j] = 0.0 if f >= 0 else -left[i].stepSize * (g / _UNIT) / (h / _UNIT + left[i].l2)
                models[i].trees.append(tree)
            # of a tree without a split the later ones would be the same
            left = {i: left[i] for i, tree in trees.items() if len(tree.feature) > 1 and k < left[i].maxIter}
            if not left:
                break
            before, moved = blocks, _advanced(blocks, d, {i: trees[i] for i in left})
            blocks = (moved.persist(StorageLevel.MEMORY_AND_DISK) if k % RESTAGE
                      else _kept(stage_table(spark.createDataFrame(moved, _BLOCK)), parts))
    finally:
        blocks.unpersist()
        if before is not None:
            before.unpersist()
    return models
