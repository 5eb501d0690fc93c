"""Corpus pipeline: documents through quality rules, the quality classifier,
SimHash near-dedup, secret scans and packing.

Each stage is written as Parquet to the shared folder and read back as the
next one's input; all but the last return the columns of ``documents``.

Rows: null and empty texts fail the quality rules and go; very long texts are
read whole by every stage; repeated rows are near duplicates of each other, so
one stays; null doc_ids stay null; extra columns of ``documents`` are not
carried; an empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clickspark.llm import packing, quality_model, quality_rules, secret_scan, simhash
from clickspark.llm.common import table
from clickspark.staging import stage_table

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("quality_classifier", quality_model.stage),
    ("simhash_near_dedup", simhash.stage),
    ("secret_scan", secret_scan.stage),
    ("packing", packing.stage),
]

#: Model fitting, components and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir))
    return docs
