"""Property tests (hypothesis): rounding rules equal the engines they
mirror on arbitrary doubles; qcut bins are monotone, cover 1..q and differ
in size by at most one."""

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from clickspark.functions.numeric import qcut_bucket, round_np, round_sql

finite = st.floats(min_value=-1e6, max_value=1e6, allow_nan=False, allow_infinity=False)


@settings(max_examples=25, deadline=None)
@given(st.lists(finite, min_size=1, max_size=40), st.integers(min_value=0, max_value=4))
def test_rounding_matches_engines(spark, xs, n):
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    got = df.select(round_sql("x", n).alias("s"), round_np("x", n).alias("p")).collect()
    con = duckdb.connect()
    for x, r in zip(xs, got):
        assert r["s"] == con.execute(f"SELECT ROUND(CAST(? AS DOUBLE), {n})", [x]).fetchone()[0]
        assert r["p"] == np.round(x, n)


@settings(max_examples=20, deadline=None)
@given(st.integers(min_value=1, max_value=400), st.sampled_from([5, 10]))
def test_qcut_bins_are_balanced(spark, n, q):
    df = spark.range(1, n + 1).selectExpr(f"CAST({n} AS BIGINT) AS n", "id AS rn")
    bins = \
        [r["b"] for r in df.select("rn", qcut_bucket("rn", "n", q).alias("b")).orderBy("rn").collect()]
    assert bins == sorted(bins) and bins[0] == 1 and max(bins) <= q
    if n >= q:
        sizes = np.bincount(bins)[1:]
        assert set(range(1, q + 1)) == set(bins) and sizes.max() - sizes.min() <= 1
