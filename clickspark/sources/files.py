"""Sources and sinks S1-S18: CSV scan with bad-row capture, multi-file
scans with per-file tagging, Parquet / CSV / JSON sinks, file inventory.

Bad CSV rows: ``PERMISSIVE`` with a ``_corrupt_record`` column, staged
(written to the shared folder) before any filter, so that every later query sees the same
good / bad split.  (``DROPMALFORMED`` decides per query, depending on which
columns the query reads.)
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickspark.functions.numeric import round_np
from clickspark.schema import CORRUPT_COL, RAW_EVENT_SCHEMA_WITH_CORRUPT, TIMESTAMP_FORMAT
from clickspark.staging import stage_table


def read_events_csv(spark: SparkSession, paths: str | Sequence[str], header: bool = True,
                    schema=RAW_EVENT_SCHEMA_WITH_CORRUPT, tag_source: bool = True) -> DataFrame:
    """One scan of one or many headered CSV files (no merge
    step), fixed schema, bad rows kept in ``_corrupt_record``, each row
    tagged with its ``source_file`` (file name) and ``source_dir`` (name of
    the containing folder)."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    df = (spark.read.schema(schema).option("header", header).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", CORRUPT_COL)
          .option("timestampFormat", TIMESTAMP_FORMAT)
          .csv(paths))
    if tag_source:
        df = df.select("*", F.col("_metadata.file_name").alias("source_file"),
                       F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("source_dir"))
    return df


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stage a permissive scan once, then split into (good rows without the
    corrupt column, bad rows), so that later queries reading only some
    columns still see the same split.  Staging writes Parquet to the shared
    folder; for bulk conversion use ``convert_csv_to_parquet``, which writes
    the split directly."""
    staged = stage_table(df)
    good = staged.where(F.col(CORRUPT_COL).isNull()).drop(CORRUPT_COL)
    bad = staged.where(F.col(CORRUPT_COL).isNotNull())
    return good, bad


def convert_csv_to_parquet(spark: SparkSession, paths: str | Sequence[str], out_dir: str,
                           bad_dir: str | None = None, clean: bool = False,
                           partition_by: Sequence[str] = ("source_file",),
                           files_per_partition: int | None = None) -> dict[str, int]:
    """Bulk conversion: CSV -> typed Parquet of the good rows (ZSTD), bad
    rows to ``bad_dir`` as JSON.  Returns ``rows_written``
    (counted in the written table) and ``rows_rejected``.  Every column is read in both passes, so
    the permissive parser flags exactly the same rows (no whole-data
    staging).  ``clean=True`` writes the cleaned rows partitioned by date
    instead of the raw typed rows."""
    from clickspark.operators.cleaning import clean_events
    from clickspark.schema import RAW_COLUMNS
    scan = read_events_csv(spark, paths)
    good = scan.where(F.col(CORRUPT_COL).isNull()).select(*RAW_COLUMNS, "source_file")
    if clean:
        write_clean_parquet(clean_events(good), out_dir, files_per_partition=files_per_partition)
    else:
        write_clean_parquet(good, out_dir, partition_by=partition_by, files_per_partition=files_per_partition)
    if bad_dir:
        (scan.where(F.col(CORRUPT_COL).isNotNull())
             .select(*RAW_COLUMNS, CORRUPT_COL, "source_file")
             .write.mode("overwrite").json(bad_dir))
    # from what was written; without a folder of bad rows they are read again
    rejected = (spark.read.text(bad_dir).count() if bad_dir
                else scan.agg(F.count(CORRUPT_COL).alias("n"), *[F.count(c) for c in RAW_COLUMNS]).first()["n"])
    return {"rows_written": spark.read.parquet(out_dir).count(), "rows_rejected": rejected}


def write_clean_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ("date",),
                        mode: str = "overwrite", max_records_per_file: int = 0,
                        files_per_partition: int | None = None) -> None:
    """ZSTD Parquet partitioned by date (so time predicates prune
    folders).  By default every task writes one file per date it holds
    (tasks x dates files); ``files_per_partition=k`` first hash-spreads the
    rows over (date, k salts), so each date gets k files from k different
    tasks (no single task per date, no tasks x dates small files);
    ``max_records_per_file`` caps file size.  Row-group size is in bytes in
    Spark (``parquet.block.size``), left to the cluster default."""
    if files_per_partition:
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(int(files_per_partition)))
        df = df.repartition(*[F.col(c) for c in partition_by], salt)
    w = df.write.mode(mode).option("compression", "zstd")
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", max_records_per_file)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_clean_parquet(spark: SparkSession, path: str) -> DataFrame:
    """S3: a cleaned event folder (partition column ``date`` discovered)."""
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str, single_file: bool = False, mode: str = "overwrite") -> None:
    """Headered CSV; a directory of part files.  ``single_file``
    only for small, already aggregated results."""
    if single_file:
        df = df.coalesce(1)
    df.write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON documents (one per row; reports are one-row frames)."""
    df.coalesce(1).write.mode(mode).json(path)


def _below(spark: SparkSession, directory: str) -> DataFrame:
    """Files below a directory: ``name``, the first part of the path relative
    to it (a file, or the folder of a table's part files), and ``length``
    (listing only, the content column is pruned)."""
    base = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/+", "/", directory).rstrip("/") + "/"
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .load(directory).select("path", "length"))
    rel = F.expr("substring(path, instr(path, b) + length(b))")
    return (files.withColumn("b", F.lit(base))
                 .select(F.element_at(F.split(rel, "/"), 1).alias("name"), "length"))


def source_inventory(spark: SparkSession, directory: str, names: Sequence[str]) -> DataFrame:
    """For each wanted name, a file or a folder of part files: found
    or not, number of files, size in bytes and GB (2 dp)."""
    found = _below(spark, directory).groupBy("name").agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("size_bytes"))
    wanted = spark.createDataFrame([(i + 1, n) for i, n in enumerate(names)], "ord int, name string")
    return (wanted.join(found, "name", "left")
                  .select("ord", "name",
                          F.when(F.col("files").isNotNull(), "found").otherwise("not_found").alias("status"),
                          F.coalesce("files", F.lit(0)).cast("long").alias("files"), "size_bytes",
                          round_np(F.col("size_bytes") / F.lit(1024.0 ** 3), 2).alias("size_gb"))
                  .orderBy("ord"))


def inventory_totals(inventory: DataFrame) -> DataFrame:
    """N1 totals: wanted and found sources, files and size."""
    size = F.coalesce(F.sum("size_bytes"), F.lit(0))
    return inventory.agg(
        F.count(F.lit(1)).alias("wanted"), F.count(F.when(F.col("status") == "found", 1)).alias("found"),
        F.sum("files").alias("files"), size.alias("total_bytes"),
        round_np(size / F.lit(1024.0 ** 3), 2).alias("total_gb"))


def output_manifest(spark: SparkSession, directory: str, expected: Sequence[str]) -> DataFrame:
    """OK / MISSING for each expected output (file or folder) below a
    directory."""
    top = _below(spark, directory).select("name").distinct()
    want = spark.createDataFrame([(i + 1, n) for i, n in enumerate(expected)], "ord int, name string")
    return (want.join(top.withColumn("_hit", F.lit(1)), "name", "left")
                .select("ord", "name", F.when(F.col("_hit") == 1, "OK").otherwise("MISSING").alias("status"))
                .orderBy("ord"))
