"""Shared small helpers of the operators: table reading, Arrow row mapping
and connected components."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from clickspark.staging import stage_table

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: The columns of ``documents``, which pipeline stages take and return.
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
DOCUMENT_COLUMNS = [c.split()[0] for c in DOCUMENTS.split(", ")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def importable(spark: SparkSession) -> None:
    """Python workers import this package from where the driver has it (a
    shared path or local mode); elsewhere ship it with ``--py-files``."""
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH", "")
    if _ROOT not in path.split(":"):
        env["PYTHONPATH"] = f"{_ROOT}:{path}".rstrip(":")


def map_rows(df: DataFrame, fn: Callable[[Iterator[dict]], Iterator[dict]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with columns as Python lists: ``fn`` gets an iterator of
    ``{column: list}`` (one per Arrow batch) and yields the same shape."""
    importable(df.sparkSession)
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        for out in fn({n: c.to_pylist() for n, c in zip(b.schema.names, b.columns)} for b in batches):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph: ``edges`` (u, v: long) -> (id, root)
    with the smallest id of the component as root, for every id on an edge.

    Alternating large-star and small-star steps: each step is a map-side
    combined ``min`` per vertex and a join on the vertex (a hot vertex is
    split by the skew join), every step's edges are staged, and the loop
    ends when the edge set (count and checksum) no longer changes."""
    e = edges.where(F.col("u") != F.col("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    e = stage_table(e.distinct())
    state = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("m").alias("u"), "v").distinct()
        # small star: e has u < v; v's smaller neighbours meet at their minimum
        low = e.groupBy("v").agg(F.min("u").alias("m"))
        j = e.join(low, "v")
        e = j.select(F.col("m").alias("u"), "v").union(
            j.where(F.col("u") != F.col("m")).select(F.col("m").alias("u"), F.col("u").alias("v"))).distinct()
        e = stage_table(e)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = e.select("u").distinct().select(F.col("u").alias("id"), F.col("u").alias("root"))
    return e.select(F.col("v").alias("id"), F.col("u").alias("root")).union(roots)


def logistic(rows: list[tuple], size: int, balance: bool = True, rounds: int = 300,
             l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient descent on sparse rows
    (features, values, soft label[, weight]); ``balance``: both classes weigh
    alike.  Runs on the driver: the caller bounds the rows."""
    weights, bias = np.zeros(size), 0.0
    if not rows:
        return weights, bias
    at = np.concatenate([np.asarray(r[0], np.int64) for r in rows])
    val = np.concatenate([np.asarray(r[1], float) for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    y = np.array([r[2] for r in rows], float)
    c = np.array([r[3] if len(r) > 3 else 1.0 for r in rows], float)
    if balance:
        c *= np.where(y > 0.5, 0.5 / max(1.0, c[y > 0.5].sum()), 0.5 / max(1.0, c[y <= 0.5].sum()))
    c /= c.sum()
    scale = 1 / np.sqrt(np.bincount(at, (val ** 2) * c[row], size) + 1e-3)
    val = val * scale[at]
    step = 1.0 / (0.25 * (np.bincount(row, val ** 2, len(rows)) * c).sum() + 0.25 + l2)
    old, z, zb, ob, t = weights, weights, 0.0, 0.0, 1.0
    for _ in range(rounds):
        s = np.bincount(row, val * z[at], len(rows)) + zb
        g = c * (1 / (1 + np.exp(-np.clip(s, -50, 50))) - y)
        new, nb = z - step * (np.bincount(at, val * g[row], size) + l2 * z), zb - step * g.sum()
        t, t0 = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        z, zb = new + (t0 - 1) / t * (new - old), nb + (t0 - 1) / t * (nb - ob)
        old, ob = new, nb
    return old * scale, float(ob)
