"""Every query with an oracle: Spark result equals the SQL oracle (DuckDB)
on the sf0.001 tables (the driver checks sf0.01)."""

import os

import pytest

import __spark_entry__ as E
from tools.oracle_check import TABLES, compare

SF = "/root/testdata/sf0.001"
NAMES = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    import duckdb
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF).toPandas()
    odf = con.execute(E.oracle_sql()[name]).df()
    assert compare(name, sdf, odf) == "OK"


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() == 1 and "view_to_cart" in df.columns
