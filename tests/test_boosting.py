"""Boosted trees against a plain growth of one leaf at a time, and attribution
against all subsets of features."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.core.rdd import PipelinedRDD

from clickspark.operators import boosting as B
from clickspark.operators import models as mo

U = 2.0 ** 32


def plain_fit(x, y, rounds, depth, rate, bins, leaves, l2, least_h, least_rows):
    """Margins after each round, splitting the open leaf of greatest gain."""
    n, d = x.shape
    edges = []
    for f in range(d):
        v = np.sort(x[:, f])
        u = np.unique(v)
        edges.append(u[:-1] if len(u) <= bins else np.unique([w for i in range(1, bins) if (w := v[-(-i * n // bins) - 1]) < v[-1]]))
    m = np.full(n, math.log(y.mean() / (1 - y.mean())))
    out, trees = [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-m))
        g, h = np.rint((p - y) * U) / U, np.rint(p * (1 - p) * U) / U

        def best(rows):
            top = None
            for f in range(d):
                for c in edges[f]:
                    le = rows[x[rows, f] <= c]
                    ri = rows[x[rows, f] > c]
                    if min(len(le), len(ri)) < max(1, least_rows) or min(h[le].sum(), h[ri].sum()) < least_h:
                        continue
                    gain = (g[le].sum() ** 2 / (h[le].sum() + l2) + g[ri].sum() ** 2 / (h[ri].sum() + l2)
                            - g[rows].sum() ** 2 / (h[rows].sum() + l2))
                    if gain > 1e-9 and (top is None or gain > top[0] + 1e-12):
                        top = (gain, f, c, le, ri)
            return top

        done, open_, splits = [], [(np.arange(n), 0)], []
        cand = [(best(r), r, k) for r, k in open_]
        while cand:
            if leaves is not None and len(splits) >= leaves - 1:
                break
            cand.sort(key=lambda b: -(b[0][0] if b[0] else 0))
            b, rows, k = cand.pop(0)
            if b is None or k >= depth:
                done.append(rows)
                continue
            splits.append((b[1], float(b[2]), len(rows)))
            cand += [(best(r) if k + 1 < depth else None, r, k + 1) for r in b[3:]]
        done += [r for _, r, _ in cand]
        for rows in done:
            m[rows] -= rate * g[rows].sum() / (h[rows].sum() + l2)
        out.append(m.copy())
        trees.append(sorted(splits))
    return out, trees


@pytest.fixture(scope="module")
def data(spark):
    rs = np.random.RandomState(4)
    x = np.column_stack([rs.randint(0, 6, 300), rs.randn(300), rs.exponential(1, 300).round(2), rs.randint(0, 2, 300)]).astype(float)
    y = ((x[:, 0] > 2) ^ (x[:, 1] > 0.3) | (rs.rand(300) < 0.15)).astype(int)
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(label=y, user_id=range(300))
    return x, y, spark.createDataFrame(pdf)


@pytest.mark.parametrize("leaves, l2, least_h, least_rows, depth", [(None, 1.0, 1.0, 1, 3), (6, 0.0, 1e-3, 10, 8)])
@pytest.mark.parametrize("parts", [1, 5])
def test_equal_to_plain_growth(data, monkeypatch, leaves, l2, least_h, least_rows, depth, parts):
    x, y, df = data
    monkeypatch.setattr(B, "BLOCK", 120)
    monkeypatch.setattr(B, "RESTAGE", 2)
    want, trees = plain_fit(x, y, 4, depth, 0.3, 16, leaves, l2, least_h, least_rows)
    m = B.fit_boosted(df.repartition(parts), features=list("abcd"), maxIter=4, maxDepth=depth, stepSize=0.3, maxBins=16,
                      leaves=leaves, l2=l2, minHessian=least_h, minRows=least_rows)
    for t, w in zip(m.trees, trees):
        assert sorted((f, thr, s[2]) for f, thr, s in zip(t.feature, t.threshold, t.sums) if f >= 0) == w
    assert np.allclose(m.margins(x), want[-1], atol=1e-9)
    got = m.predict(df).toPandas().sort_values("user_id").score.to_numpy()
    assert np.allclose(got, 1 / (1 + np.exp(-want[-1])), atol=1e-9)


def test_attribution_equals_all_subsets(data):
    x, y, df = data
    rs = np.random.RandomState(9)
    x8 = np.column_stack([x, rs.randn(300, 4)])
    names = list("abcdefgh")
    wide = df.sparkSession.createDataFrame(pd.DataFrame(x8, columns=names).assign(label=y, user_id=range(300)))
    m = B.fit_boosted(wide, features=names, maxIter=3, maxDepth=6, stepSize=0.5, leaves=20, l2=0.0, minRows=5)

    def value(t, node, row, known):
        if t.feature[node] < 0:
            return t.value[node]
        f, kids = t.feature[node], (t.left[node], t.right[node])
        if f in known:
            return value(t, kids[int(row[f] > t.threshold[node])], row, known)
        return sum(t.sums[c][1] / t.sums[node][1] * value(t, c, row, known) for c in kids)

    got = m.shapley(x8[:3])
    for row, phi in zip(x8[:3], got):
        v = {s: sum(value(t, 0, row, s) for t in m.trees) for k in range(9) for s in itertools.combinations(range(8), k)}
        for f in range(8):
            others = [o for o in range(8) if o != f]
            want = sum(math.factorial(k) * math.factorial(7 - k) / math.factorial(8)
                       * (v[tuple(sorted((*s, f)))] - v[s]) for k in range(8) for s in itertools.combinations(others, k))
            assert abs(want - phi[f]) < 1e-9
    assert np.allclose(got.sum(1) + m.expected(), m.margins(x8[:3]))
    per_row = m.attributions(wide).groupBy("user_id").sum("phi").toPandas().set_index("user_id")["sum(phi)"]
    assert np.allclose([per_row[i] for i in range(3)], got.sum(1))


def test_missing_values_one_class_and_no_rows(spark, data):
    x, y, df = data
    from pyspark.sql import functions as F
    holes = df.withColumn("a", F.when(F.col("user_id") % 3 > 0, F.col("a"))).withColumn(
        "b", F.when(F.col("user_id") % 5 == 0, float("nan")).otherwise(F.col("b")))
    m = B.fit_boosted(holes, features=list("abcd"), maxIter=2, maxDepth=2)
    s = m.predict(holes).toPandas().score
    assert s.between(0, 1).all()
    one = B.fit_boosted(df.where("label = 1"), features=list("abcd"), maxIter=2)
    assert set(one.predict(df).toPandas().score) == {1.0}
    none = B.fit_boosted(df.limit(0), features=list("abcd"), maxIter=2)
    assert none.trees == [] and set(none.predict(df).toPandas().score) == {0.5}


def test_sample_and_importances(data):
    x, y, df = data
    m = B.fit_boosted(df, features=list("abcd"), maxIter=3, maxDepth=3)
    count = {r["feature"]: r["importance"] for r in mo.importance_split_count(m, list("abcd")).collect()}
    assert sum(count.values()) == sum(f >= 0 for t in m.trees for f in t.feature)
    assert abs(sum(r["importance"] for r in mo.importance_gain(m, list("abcd")).collect()) - 1) < 1e-12
    sample = {r["user_id"] for r in mo.seeded_sample(df, 20).collect()}
    assert sample == {r["user_id"] for r in mo.seeded_sample(df.repartition(7), 20).collect()} and len(sample) == 20
    shap = mo.shap_importance(m, df, df, list("abcd"))
    assert [r["feature"] for r in shap.collect()][0] in "ab"


def test_driver_sees_splits_not_cells(data, monkeypatch):
    """What a level sends to the driver is a few numbers per node and feature,
    whatever the bins, and what a tree shuffles follows the bins in use."""
    x, y, df = data
    monkeypatch.setattr(B, "BLOCK", 60)
    names = list("abcd")
    edges = B.bin_edges(df, names, 256)
    blocks = B._kept(B.stage_table(B._pack(df.repartition(5), names, "label", edges, 0.0)))
    assert blocks.getNumPartitions() <= df.sparkSession.sparkContext.defaultParallelism
    sent = []
    collect = type(blocks).collect

    def watched(rdd):
        sent.extend(collect(rdd))
        return sent

    monkeypatch.setattr(PipelinedRDD, "collect", watched)
    total, found = B._splits(blocks, 4, B.Tree(), [0], edges, 1.0, 1.0, 1)
    assert total[2] == len(y) and found[0][1] in range(4)
    assert len(sent) == 4 and not any(isinstance(v, np.ndarray) for row in sent for v in row)
    cells = {f: s.shape for f, s in blocks.mapPartitions(lambda p: B._sums(p, 4, B.Tree(), [0], [len(e) + 1 for e in edges])).take(4)}
    assert cells[0] == (3, 1, 6) and cells[3] == (3, 1, 2)
    blocks.unpersist()


def test_bins_are_placed_by_all_rows(spark):
    """Cut values of more rows than were once sampled: the values at ranks
    ceil(i * n / bins) of every row, missing ones apart."""
    from pyspark.sql import functions as F
    n = 200_007
    x = (F.col("id") * 7919) % n
    df = spark.range(n).select(
        F.when(F.col("id") % 7 > 0, F.pow(x.cast("double") / n, F.lit(3.0))).otherwise(F.lit(float("nan"))).alias("a"),
        F.when(x % 11 > 0, F.floor(F.sqrt(x))).alias("b"), (x == 5).cast("int").alias("c"), F.lit(None).cast("double").alias("e"))
    pdf = df.toPandas()
    got = B.bin_edges(df.repartition(5), list("abce"), 256)
    for name, edges in zip("ab", got):
        v = np.sort(pdf[name].dropna().to_numpy(float))
        cuts = np.unique(v[[-(-i * len(v) // 256) - 1 for i in range(1, 256)]])
        assert len(np.unique(v)) > 256 and edges.tolist() == cuts[cuts < v[-1]].tolist()
    assert got[2].tolist() == [0.0] and got[3].tolist() == []


def test_models_grown_side_by_side(data, monkeypatch):
    """The same trees as each by itself, a level of all of them in one job; a
    model of one class, or one that is done early, holds up no other."""
    x, y, df = data
    monkeypatch.setattr(B, "BLOCK", 50)
    monkeypatch.setattr(B, "RESTAGE", 2)
    less = df.where("user_id % 3 > 0")
    asked = [(df, dict(maxIter=3, maxDepth=2, maxBins=16)), (df.where("label = 1"), {}),
             (less, dict(maxIter=4, maxDepth=4, maxBins=20, leaves=6, l2=0.0, minHessian=1e-3, minRows=10)),
             (less, dict(maxIter=5, maxDepth=3, minRows=10_000)), (df, dict(maxIter=3, maxDepth=3, maxBins=20))]
    alone = [B.fit_boosted(t, features=list("abcd"), **s) for t, s in asked]
    jobs = []
    level = B._level
    monkeypatch.setattr(B, "_level", lambda *a: jobs.append(1) or level(*a))
    for m, w in zip(B.fit_boosted_together(asked, features=list("abcd")), alone, strict=True):
        assert m.base == w.base and m.trees == w.trees
    assert [len(m.trees) for m in alone] == [3, 0, 4, 1, 3]
    assert len(jobs) <= 4 * 4  # trees and levels of the longest


def test_comparison_grows_split_and_folds_together(data, monkeypatch):
    """A job per level of a model's trees, not of each of its fits."""
    x, y, df = data
    monkeypatch.setattr(mo, "split", lambda ds, label: (ds.where("user_id % 5 > 0"), ds.where("user_id % 5 = 0")))
    monkeypatch.setattr(mo, "MODEL_PARAMS", {"XGBoost": dict(maxIter=2, maxDepth=2)})
    wide = df.select("user_id", "label", *[df[c].alias(n) for n, c in zip(mo.FEATURE_COLS, itertools.cycle("abcd"))])
    jobs = []
    collect = PipelinedRDD.collect
    monkeypatch.setattr(PipelinedRDD, "collect", lambda rdd: jobs.append(1) or collect(rdd))
    table, fitted = mo.model_comparison(wide, models=("XGBoost",))
    assert len(fitted["XGBoost"].trees) == 2
    assert table.count() == 1 and len(jobs) == 4
