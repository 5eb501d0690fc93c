import os

import duckdb
import pytest

from clickspark.llm import queries as Q
from tools.oracle_check import TABLES, compare


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    assert compare(name, Q.QUERIES[name](spark, sf).toPandas(), con.execute(Q.ORACLE[name]).df()) == "OK"
