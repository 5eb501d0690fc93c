import numpy as np
from pyspark.sql import functions as F
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clickspark.operators.ranking import global_rank, qcut_rank, quantiles


@pytest.mark.parametrize("nparts", [1, 4, 17])
def test_global_rank_skewed(spark, nparts):
    rs = np.random.RandomState(nparts)
    v = rs.randint(0, 50, 1500).astype(float)
    v[::3] = 7.0   # one value holds a third of the rows
    pdf = pd.DataFrame({"user_id": np.arange(1500), "v": v})
    df = spark.createDataFrame(pdf).repartition(5)
    got = global_rank(df, [F.col("v"), F.col("user_id")], num_partitions=nparts).toPandas().sort_values("user_id")
    exp = pdf.sort_values(["v", "user_id"]).assign(rn=np.arange(1, 1501)).sort_values("user_id")
    assert (got.rn.values == exp.rn.values).all() and (got.n == 1500).all()


def test_qcut_rank_matches_pandas(spark):
    pdf = pd.DataFrame({"user_id": np.arange(403), "v": np.random.RandomState(3).randint(0, 9, 403)})
    df = spark.createDataFrame(pdf)
    got = qcut_rank(df, "v", 5).toPandas().sort_values("user_id")
    o = pdf.sort_values(["v", "user_id"])
    o["b"] = pd.qcut(o.v.rank(method="first"), 5, labels=False) + 1
    assert (got.bin.values == o.sort_values("user_id").b.values).all()


def test_quantiles_numpy_and_sql(spark):
    x = np.random.RandomState(1).exponential(10, 777)
    df = spark.createDataFrame([(float(a),) for a in x], "h double")
    ps = [0.25, 0.5, 0.75, 0.95, 0.8]
    got = quantiles(df, "h", ps).first()
    exp = pd.Series(x).quantile(ps).values
    assert np.allclose(list(got), exp, rtol=0, atol=1e-12)
    assert list(got) == list(exp)


def test_hot_value_is_split_across_partitions(spark):
    """A value holding a third of the rows does not land in one range
    partition: the tie-break key spreads it."""
    from pyspark.sql import functions as F
    n = 30000
    df = spark.range(n).select(F.col("id").alias("user_id"),
                               F.when(F.col("id") % 3 == 0, F.lit(5.0)).otherwise((F.col("id") % 1000).cast("double")).alias("v"))
    ranged = df.repartitionByRange(12, F.col("v"), F.col("user_id"))
    sizes = [r["c"] for r in ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("c")).collect()]
    assert max(sizes) < n / 3 * 0.6, sizes   # the hot value spans several partitions
    r = global_rank(df, [F.col("v"), F.col("user_id")], num_partitions=12)
    assert r.agg(F.max("rn")).first()[0] == n


def test_hot_user_transitions_split(spark, make_events):
    """One user with a third of the events: the transition pass spreads that
    user's timeline over several partitions and still counts every pair."""
    from clickspark.operators import sequence as sq
    rows = []
    for i in range(3000):
        u = 1 if i % 3 == 0 else 2 + i % 50
        rows.append((u, f"2024-01-0{1 + i % 9}T{(i // 60) % 24:02d}:{i % 60:02d}:00", "view" if i % 4 else "cart", i % 7))
    ev = make_events(rows)
    by_part = (ev.where("user_id = 1").repartitionByRange(8, "user_id", "event_time", "event_type", "product_id", "price")
                 .groupBy(F.spark_partition_id()).count().count())
    assert by_part > 1
    got = sum(r["count"] for r in sq.transition_counts(ev, num_partitions=8).collect())
    users = ev.groupBy("user_id").count().collect()
    assert got == sum(u["count"] - 1 for u in users)


@pytest.mark.parametrize("pick", [0, 10_000])
def test_quantiles_with_a_hot_value(spark, monkeypatch, pick):
    """However few rows are fetched at the end, the passes narrow down to
    the same values; 99 % of the rows share one."""
    from clickspark.operators import ranking
    monkeypatch.setattr(ranking, "PICK", pick)
    x = np.random.RandomState(5).lognormal(0, 9, 5000)
    x[np.arange(5000) % 100 > 0] = 17.0
    x[:3] = [np.inf, -np.inf, 1e308]
    df = spark.createDataFrame([(float(a),) for a in x], "h double")
    ps = [0.001, 0.004, 0.5, 0.9, 0.996, 0.999]
    assert list(quantiles(df, "h", ps).first()) == list(pd.Series(x).quantile(ps).values)


def test_quantile_plans_have_no_sort_and_no_single_task(spark):
    """The histogram passes are combined before the shuffle: no task gets
    more rows than there are bins, whatever the values."""
    from pyspark.sql import functions as F
    df = spark.range(200_000).select(F.when(F.col("id") % 100 > 0, 5.0).otherwise(F.col("id").cast("double")).alias("v"))
    assert quantiles(df, "v", [0.5, 0.999], materialize=False).first()[0] == 5.0
    plan = quantiles(df, "v", [0.5], materialize=False)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "Window" not in plan  # the row holds the results


def test_column_quantiles_matches_pandas(spark):
    from clickspark.operators.ranking import column_quantiles
    rs = np.random.RandomState(9)
    pdf = pd.DataFrame({"a": rs.exponential(5, 500), "b": rs.randint(0, 7, 500).astype(float),
                        "c": np.full(500, 3.0)})
    pdf.loc[::10, "a"] = np.nan
    df = spark.createDataFrame(pdf)
    ps = [0.25, 0.5, 0.75]
    got = column_quantiles(df, ["a", "b", "c"], ps)
    for c in "abc":
        assert got[c] == list(pdf[c].quantile(ps).values), c


def passes(monkeypatch):
    """Counts the results fetched from Spark."""
    from pyspark.sql.classic.dataframe import DataFrame
    n, real = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: n.append(1) or real(self))
    return n


@pytest.mark.parametrize("pick", [0, 10_000])
def test_six_passes_at_most(spark, monkeypatch, pick):
    """Whatever the range and the bits of the values: 600 decades, neighbouring
    doubles, whole numbers over the whole bigint range."""
    from clickspark.operators import ranking
    monkeypatch.setattr(ranking, "PICK", pick)
    rs = np.random.RandomState(11)
    wide = rs.choice([-1, 1], 4000) * 10.0 ** rs.uniform(-300, 300, 4000)
    near = 1.0 + rs.randint(0, 5000, 4000) * 2.0 ** -52
    tiny = rs.randint(-500, 500, 4000) * 5e-324
    ends = np.where(np.arange(4000) % 3 == 0, np.inf, -0.0)
    whole = rs.randint(-2 ** 62, 2 ** 62, 4000)
    pdf = pd.DataFrame({"wide": wide, "near": near, "tiny": tiny, "ends": ends, "whole": whole})
    df = spark.createDataFrame(pdf)
    ps = [0.0, 0.001, 0.25, 0.5, 0.777, 0.9, 1.0]
    got_passes = passes(monkeypatch)
    got = ranking.column_quantiles(df, list(pdf), ps)
    assert len(got_passes) <= 6
    for c in ("wide", "near", "tiny"):
        assert got[c] == list(pdf[c].quantile(ps).values), c
    s = np.sort(whole)
    assert got["whole"][0] == float(s[0]) and got["whole"][-1] == float(s[-1])
    assert [got["ends"][i] for i in (0, 3, 6)] == [0.0, 0.0, np.inf]


def test_ordered_keys(spark):
    """Keys sort like their doubles and give them back to the bit."""
    from clickspark.functions.numeric import ordered_key, value_of_key
    rs = np.random.RandomState(12)
    x = np.concatenate([rs.randint(0, 2 ** 64, 3000, dtype=np.uint64).view(float), [0.0, 5e-324, 2.0 ** -1022, 1e308, np.inf],
                        2.0 ** np.arange(-1074, 1024, 7), np.nextafter(2.0 ** np.arange(-1000, 1024, 9), 0)])
    x = np.concatenate([x[~np.isnan(x)], -x[~np.isnan(x)]])
    rows = spark.createDataFrame([(float(v),) for v in x], "v double").select("v", ordered_key("v").alias("k")).collect()
    assert all(value_of_key(r["k"]) == r["v"] for r in rows)
    by_key = [r["v"] for r in sorted(rows, key=lambda r: r["k"])]
    assert by_key == sorted(by_key)
    none = spark.createDataFrame([(float("nan"),), (None,)], "v double").select(ordered_key("v").alias("k")).collect()
    assert [r["k"] for r in none] == [None, None]


def test_quantiles_approx_option(spark):
    x = np.arange(10001, dtype=float)
    df = spark.createDataFrame([(float(a),) for a in x], "h double")
    got = quantiles(df, "h", [0.5, 0.9], accuracy=10000).first()
    assert abs(got[0] - 5000) <= 2 and abs(got[1] - 9000) <= 2
