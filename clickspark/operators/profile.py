"""Profiling of raw and clean events, N2-N6 and N8-N11 (N8 is in funnel).

All are single aggregations (map-side partial aggregation, one small
shuffle); per-file profiling is one ``groupBy(source_file)`` instead of
four scans per file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickspark.functions.numeric import count_when, round_sql

# Fixed threshold of the reference's missing-value policy (percent of rows
# with both brand and category missing below which such rows are removed).
BOTH_MISSING_REMOVE_PCT = 2.0


def file_profile(raw: DataFrame, file_col: str = "source_file") -> DataFrame:
    """Per source file rows, time range and missing brand / category /
    price counts with their %."""
    n = F.count("*")
    g = raw.groupBy(file_col).agg(
        n.alias("rows"),
        F.min("event_time").alias("min_date"), F.max("event_time").alias("max_date"),
        (n - F.count("brand")).alias("missing_brand"),
        (n - F.count("category_code")).alias("missing_category"),
        (n - F.count("price")).alias("missing_price"))
    pct = lambda c: (F.col(c) / F.col("rows") * F.lit(100.0)).alias(c + "_pct")
    return (g.select(F.col(file_col).alias("filename"), "rows", "min_date", "max_date",
                     "missing_brand", "missing_category", "missing_price",
                     pct("missing_brand"), pct("missing_category"), pct("missing_price"))
             .orderBy("filename"))


def file_event_mix(raw: DataFrame, file_col: str = "source_file") -> DataFrame:
    """Per source file and event type: count and % of the file's rows."""
    g = raw.groupBy(file_col, "event_type").agg(F.count("*").alias("count"))
    tot = F.sum("count").over(Window.partitionBy(file_col))  # rows of one file: a few types
    return (g.select(F.col(file_col).alias("filename"), "event_type", "count",
                     (F.col("count") / tot * F.lit(100.0)).alias("pct"))
             .orderBy("filename", F.desc("count"), "event_type"))


def dataset_stats(raw: DataFrame, approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """Rows, distinct users / products / sessions, earliest and latest
    event.  ``approx=True`` uses HyperLogLog++ sketches (for profiling at
    scale: one pass, no Expand of the rows)."""
    cd = (lambda c: F.approx_count_distinct(c, rsd)) if approx else F.countDistinct
    return raw.agg(F.count("*").alias("total_rows"),
                   cd("user_id").alias("unique_users"),
                   cd("product_id").alias("unique_products"),
                   cd("user_session").alias("unique_sessions"),
                   F.min("event_time").alias("earliest_date"),
                   F.max("event_time").alias("latest_date"))


def missing_patterns(raw: DataFrame) -> DataFrame:
    """Rows per (brand missing, category missing) combination with %."""
    g = raw.groupBy(F.col("brand").isNull().cast("int").alias("brand_missing"),
                    F.col("category_code").isNull().cast("int").alias("category_missing")).agg(
        F.count("*").alias("count"))
    tot = F.sum("count").over(Window.partitionBy())  # at most four rows
    return (g.select("brand_missing", "category_missing", "count",
                     (F.col("count") / tot * F.lit(100.0)).alias("pct"))
             .orderBy(F.desc("count"), "brand_missing", "category_missing"))


def missing_policy(patterns: DataFrame) -> DataFrame:
    """The treatment decided for each missing pattern: both missing ->
    'remove' below 2 % of rows else 'fill'; brand only -> 'fill';
    category only -> 'infer'.  (The cleaning step always fills.)"""
    b, c = F.col("brand_missing"), F.col("category_missing")
    s = patterns.agg(
        F.sum("count").alias("total"),
        F.sum(F.when((b == 1) & (c == 1), F.col("count")).otherwise(0)).alias("both"),
        F.sum(F.when((b == 1) & (c == 0), F.col("count")).otherwise(0)).alias("brand_only"),
        F.sum(F.when((b == 0) & (c == 1), F.col("count")).otherwise(0)).alias("cat_only"))
    pct = lambda x: F.when(F.col("total") > 0, F.col(x) / F.col("total") * F.lit(100.0)).otherwise(0.0)
    rows = F.array(
        F.struct(F.lit("both_missing").alias("pattern"), F.col("both").cast("long").alias("rows"),
                 pct("both").alias("pct"),
                 F.when(pct("both") < BOTH_MISSING_REMOVE_PCT, "remove").otherwise("fill").alias("decision")),
        F.struct(F.lit("only_brand_missing").alias("pattern"), F.col("brand_only").cast("long").alias("rows"),
                 pct("brand_only").alias("pct"), F.lit("fill").alias("decision")),
        F.struct(F.lit("only_category_missing").alias("pattern"), F.col("cat_only").cast("long").alias("rows"),
                 pct("cat_only").alias("pct"), F.lit("infer").alias("decision")))
    return s.select(F.inline(rows))


def event_distribution(ev: DataFrame, decimals: int | None = 2) -> DataFrame:
    """Events per type with % of all, by count.  ``decimals=2`` is the
    notebook's SQL-rounded share; ``None`` the preprocessing step's
    unrounded one (over raw rows)."""
    g = ev.groupBy("event_type").agg(F.count("*").alias("n"))
    tot = F.sum("n").over(Window.partitionBy())  # one row per event type
    pct = F.col("n") * F.lit(100.0) / tot
    if decimals is not None:
        pct = round_sql(pct, decimals)
    return g.select("event_type", "n", pct.alias("pct")).orderBy(F.desc("n"), "event_type")


def hourly_events(ev: DataFrame) -> DataFrame:
    """Events and purchases per hour."""
    return (ev.groupBy("hour").agg(F.count("*").alias("events"),
                                   count_when(F.col("event_type") == "purchase").alias("purchases"))
              .orderBy("hour"))


def brand_performance(ev: DataFrame, k: int = 10) -> DataFrame:
    """Known brands: events, rows whose brand was filled, purchases;
    top k by events (ties by brand)."""
    return (ev.where(F.col("brand") != "Unknown").groupBy("brand")
              .agg(F.count("*").alias("total_events"),
                   F.sum("brand_was_missing").cast("long").alias("was_filled"),
                   count_when(F.col("event_type") == "purchase").alias("purchases"))
              .orderBy(F.desc("total_events"), "brand").limit(k))


def top_brands(raw: DataFrame, k: int = 10) -> DataFrame:
    """Non-null brands by events, top k (ties by brand)."""
    return (raw.where(F.col("brand").isNotNull()).groupBy("brand")
               .agg(F.count("*").alias("events"))
               .orderBy(F.desc("events"), "brand").limit(k))
