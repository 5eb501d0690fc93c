import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clickspark.functions.numeric import minute_boundaries, qcut_bucket, round_np, round_sql, whole_days_between
from tests.conftest import ts


def test_round_rules(spark):
    vals = [1.005, 2.675, 0.125, 0.135, -2.5, 12.345, 0.285, 1e-9, 0.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = df.select(round_sql("x", 2).alias("s"), round_np("x", 2).alias("n")).collect()
    import duckdb
    con = duckdb.connect()
    for v, r in zip(vals, got):
        assert r["s"] == con.execute(f"SELECT ROUND({v}::DOUBLE, 2)").fetchone()[0]
        assert r["n"] == np.round(v, 2)


def test_round_np_random(spark):
    x = np.random.RandomState(0).uniform(-1000, 1000, 2000).round(3)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = np.array([r[0] for r in df.select(round_np("x", 2)).collect()])
    assert (got == pd.Series(x).round(2).values).all()


def _qcut_expected(n, q):
    return (pd.qcut(pd.Series(range(1, n + 1)).rank(method="first"), q, labels=False) + 1).tolist()


def test_qcut_bucket_matches_pandas(spark):
    rows = [(n, r) for n in range(2, 80) for r in range(1, n + 1)]
    df = spark.createDataFrame(rows, "n long, rn long")
    got = {}
    for r in df.select("n", "rn", qcut_bucket("rn", "n", 5).alias("b")).collect():
        got.setdefault(r["n"], {})[r["rn"]] = r["b"]
    for n in range(5, 80):
        assert [got[n][i] for i in range(1, n + 1)] == _qcut_expected(n, 5), n


def test_qcut_small_cases(spark):
    df = spark.createDataFrame([(7, i) for i in range(1, 8)] + [(6, i) for i in range(1, 7)] + [(1, 1)],
                               "n long, rn long")
    got = {(r.n, r.rn): r.b for r in df.select("n", "rn", qcut_bucket("rn", "n", 5).alias("b")).collect()}
    assert [got[(7, i)] for i in range(1, 8)] == [1, 1, 2, 3, 4, 5, 5]
    assert [got[(6, i)] for i in range(1, 7)] == [1, 1, 2, 3, 4, 5]
    assert got[(1, 1)] == 1  # the reference raises here


def test_minute_boundaries_and_days(spark):
    df = spark.createDataFrame([(ts("2024-01-01T10:00:59"), ts("2024-01-01T10:01:01"),
                                 ts("2024-01-01T23:00:00"), ts("2024-01-03T22:00:00"))],
                               "a timestamp, b timestamp, c timestamp, d timestamp")
    r = df.select(minute_boundaries("a", "b").alias("m"), whole_days_between("c", "d").alias("days"),
                  ((F.unix_micros("b") - F.unix_micros("a")) / 6e7).alias("frac")).first()
    assert r["m"] == 1
    assert r["days"] == 1
    assert abs(r["frac"] - 0.0333) < 1e-3


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_sums_are_exact_at_any_partitioning(spark, parts):
    """Three-decimal prices, values of 30 decades and both signs: the double
    nearest to the true sum, as exact SQL gives it."""
    import random
    from fractions import Fraction

    import duckdb
    from clickspark.functions.numeric import exact_avg, exact_parts, exact_sum, exact_value, merge_parts
    from clickspark.plans.oracle import xavg, xsum
    rng = random.Random(1)
    x = ([(i % 3, round(rng.uniform(0.005, 5000), 3), 1) for i in range(4000)]
         + [(3, rng.choice((-1, 1)) * rng.random() * 2.0 ** rng.randint(-7, 45), 0) for _ in range(3000)]
         + [(4, 0.1, 1)] * 10 + [(5, None, 1), (6, 1e300, 1), (6, 1.0, 1), (7, float("inf"), 1), (7, 2.0, 1)])
    df = spark.createDataFrame(x, "g int, p double, c int").repartition(parts)
    got = {r["g"]: r for r in df.groupBy("g").agg(exact_sum("p").alias("s"), exact_avg("p").alias("a"),
                                                  exact_sum("p", F.col("c") == 0).alias("z")).collect()}
    two = df.groupBy("g", "c").agg(exact_parts("p").alias("e")).groupBy("g").agg(exact_value(merge_parts("e")).alias("s"))
    assert {r["g"]: r["s"] for r in two.collect()} == {g: r["s"] for g, r in got.items()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t (g INT, p DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", [r[:2] for r in x if r[0] < 5])
    sql = dict((g, (s, a)) for g, s, a in con.execute(f"SELECT g, {xsum('p')}, {xavg('p')} FROM t GROUP BY g").fetchall())
    for g in range(5):
        vals = [v for k, v, _ in x if k == g]
        assert got[g]["s"] == float(sum(map(Fraction, vals))) == sql[g][0]
        assert got[g]["a"] == got[g]["s"] / len(vals) == sql[g][1]
    assert got[3]["z"] == got[3]["s"] and got[0]["z"] is None
    assert got[5]["s"] is None and got[5]["a"] is None
    assert got[6]["s"] == 1e300 and got[7]["s"] == float("inf")
