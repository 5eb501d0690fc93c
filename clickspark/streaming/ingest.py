"""Incremental ingest with Structured Streaming: new raw CSV files in a
folder -> cleaned Parquet, the same ``clean_events`` rule as the batch
path.

Each micro-batch is split once into good and bad rows (a permissive CSV
scan with ``_corrupt_record``, cached for the batch so both writes see the
same split).  Writes are idempotent per batch id (``batch=<id>`` folders
written in overwrite mode), so a retried batch replaces its own output and
the file-source checkpoint gives exactly-once ingestion of every file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clickspark.operators.cleaning import clean_events
from clickspark.schema import CORRUPT_COL, RAW_EVENT_SCHEMA_WITH_CORRUPT, TIMESTAMP_FORMAT


def raw_event_stream(spark: SparkSession, src_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    r = (spark.readStream.schema(RAW_EVENT_SCHEMA_WITH_CORRUPT)
         .option("header", True).option("mode", "PERMISSIVE")
         .option("columnNameOfCorruptRecord", CORRUPT_COL)
         .option("timestampFormat", TIMESTAMP_FORMAT)
         .option("recursiveFileLookup", "true"))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.csv(src_dir)


def stream_clean_events(spark: SparkSession, src_dir: str, out_dir: str, checkpoint: str,
                        bad_dir: str | None = None, available_now: bool = True,
                        max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start the ingest stream; ``available_now`` processes what is there
    and stops (scheduled runs), otherwise it keeps polling."""

    def write_batch(df: DataFrame, batch_id: int) -> None:
        b = df.persist()
        try:
            good = b.where(F.col(CORRUPT_COL).isNull()).drop(CORRUPT_COL)
            (clean_events(good).write.mode("overwrite").option("compression", "zstd")
             .partitionBy("date").parquet(f"{out_dir.rstrip('/')}/batch={batch_id}"))
            if bad_dir:
                (b.where(F.col(CORRUPT_COL).isNotNull()).write.mode("overwrite")
                  .json(f"{bad_dir.rstrip('/')}/batch={batch_id}"))
        finally:
            b.unpersist()

    w = (raw_event_stream(spark, src_dir, max_files_per_trigger).writeStream
         .foreachBatch(write_batch).option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def read_streamed(spark: SparkSession, out_dir: str) -> DataFrame:
    """The cleaned events written by the stream (all batches)."""
    from clickspark.schema import CLEAN_COLUMNS
    return spark.read.parquet(out_dir).select(*CLEAN_COLUMNS)
