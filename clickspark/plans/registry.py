"""Named queries: ``name -> (spark, sf_dir) -> DataFrame`` over the test
tables, each paired (where SQL can say it) with oracle SQL in ``ORACLE``.

Every query reads the given tables (through the fixture adapter and the
cleaning step, materialised once per input folder) and runs the whole
operator; outputs carry timestamps as TIMESTAMP_NTZ (UTC wall clock) so
that they compare with a zone-less SQL engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql import functions as F

from clickspark.fixtures import clean_fixture

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def ntz(df: DataFrame) -> DataFrame:
    """Zoned timestamps and dates -> TIMESTAMP_NTZ (session zone is UTC; a
    date becomes its midnight, as SQL DATE_TRUNC gives)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.TimestampType, T.DateType)):
            cols.append(F.col(f.name).cast("timestamp_ntz").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def query(name: str, sql: str | None = None):
    """Register ``fn(ev, spark, sf_dir)`` -> DataFrame under ``name``."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str, _fn=fn) -> DataFrame:
            return ntz(_fn(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def ev_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_fixture(spark, sf_dir, "orders")


def ev_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_fixture(spark, sf_dir, "events")


_CUTOFFS: dict[tuple, object] = {}


def cutoff(spark: SparkSession, sf_dir: str):
    """The time cutoff of the orders fixture, found once per application and
    input (path, sizes and times of its files)."""
    from clickspark.fixtures import _TABLES, _fingerprint
    from clickspark.operators.features import cutoff_value
    key = spark.sparkContext.applicationId, sf_dir, _fingerprint(spark, sf_dir, _TABLES["orders"])
    if key not in _CUTOFFS:
        _CUTOFFS[key] = cutoff_value(ev_orders(spark, sf_dir))
    return _CUTOFFS[key]


def load_all() -> None:
    """Import the query modules (each registers its queries)."""
    from clickspark.plans import (  # noqa: F401
        q_profile, q_funnel, q_sessions, q_sequence, q_users, q_features,
        q_value, q_models, q_boosting, q_jobs, q_sinks, q_order,
    )
