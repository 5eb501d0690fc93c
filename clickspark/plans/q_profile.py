"""Profiling and ingestion queries N1-N6, N9-N11, S1-S5 and their oracle SQL."""

from pyspark.sql import functions as F

from clickspark.fixtures import raw_fixture
from clickspark.operators import profile as pr
from clickspark.plans.oracle import ORDERS_RAW, rsql, with_ev
from clickspark.plans.registry import ev_orders, query
from clickspark.staging import new_path, shared_folder
from clickspark.sources import files as src

# Raw events are tagged with a monthly "source file", as the reference's
# inputs are monthly files.
MONTH_TAG_SPARK = "yyyy-MMMM"
MONTH_TAG_SQL = "'%Y-%B'"
CSV_TS = "yyyy-MM-dd HH:mm:ss z"


def raw_tagged(spark, d):
    r = raw_fixture(spark, d)
    return r.withColumn("source_file", F.concat(F.date_format("event_time", MONTH_TAG_SPARK), F.lit(".csv")))


def raw_sql(body: str, *ctes: str) -> str:
    tagged = f"rt AS (SELECT *, strftime(event_time, {MONTH_TAG_SQL}) || '.csv' AS source_file FROM raw)"
    return "WITH " + ",\n".join(p.strip() for p in (ORDERS_RAW, tagged, *ctes)) + "\n" + body


FILE_PROFILE_SQL = """SELECT {f} AS filename, COUNT(*) AS rows, MIN(event_time) AS min_date, MAX(event_time) AS max_date,
  COUNT(*) - COUNT(brand) AS missing_brand, COUNT(*) - COUNT(category_code) AS missing_category,
  COUNT(*) - COUNT(price) AS missing_price,
  CAST(COUNT(*) - COUNT(brand) AS DOUBLE) / COUNT(*) * 100.0 AS missing_brand_pct,
  CAST(COUNT(*) - COUNT(category_code) AS DOUBLE) / COUNT(*) * 100.0 AS missing_category_pct,
  CAST(COUNT(*) - COUNT(price) AS DOUBLE) / COUNT(*) * 100.0 AS missing_price_pct
FROM rt GROUP BY 1"""


@query("source_inventory")
def _si(spark, d):
    return src.source_inventory(spark, d, ["lineitem.parquet", "orders.parquet", "part.parquet",
                                           "events.parquet", "clickstream_2019_oct.csv"])


INVENTORY = ("lineitem", "orders", "part", "events")


@query("source_inventory_rows", "\nUNION ALL ".join(
    [f"SELECT '{n}.parquet' AS name, 'found' AS status, COUNT(*) AS \"rows\" FROM {n}" for n in INVENTORY]
    + ["SELECT 'clickstream_2019_oct.csv', 'not_found', CAST(NULL AS BIGINT)"]))
def _sir(spark, d):
    """The inventory, with the rows that a scan of each found table gives."""
    inv = _si(spark, d)
    rows = None
    for n in INVENTORY:
        one = (spark.read.parquet(f"{d.rstrip('/')}/{n}.parquet").agg(F.count(F.lit(1)).alias("rows"))
               .select(F.lit(f"{n}.parquet").alias("name"), "rows"))
        rows = one if rows is None else rows.union(one)
    return inv.select("name", "status").join(rows, "name", "left")


@query("file_profile", raw_sql(FILE_PROFILE_SQL.format(f="source_file")))
def _fp(spark, d):
    return pr.file_profile(raw_tagged(spark, d))


@query("file_event_mix", raw_sql("""SELECT source_file AS filename, event_type, COUNT(*) AS "count",
  CAST(COUNT(*) AS DOUBLE) / SUM(COUNT(*)) OVER (PARTITION BY source_file) * 100.0 AS pct
FROM rt GROUP BY source_file, event_type"""))
def _fem(spark, d):
    return pr.file_event_mix(raw_tagged(spark, d))


def _csv_path(spark, d):
    import hashlib
    return f"{shared_folder(spark, 'clickspark_csv')}/{hashlib.sha1(d.encode()).hexdigest()[:12]}"


def _csv_staged(spark, d):
    """Raw events written as monthly CSV folders in the checkpoint area,
    then scanned back in one permissive read (bad rows captured, staged)."""
    path = _csv_path(spark, d)
    r = raw_fixture(spark, d).withColumn("source_month", F.date_format("event_time", MONTH_TAG_SPARK))
    (r.write.mode("overwrite").partitionBy("source_month").option("header", True)
      .option("timestampFormat", CSV_TS).csv(path))
    dirs = [f"{path}/source_month={m}" for m in
            [row[0] for row in r.select("source_month").distinct().collect()]]  # a few month folders
    good, _bad = src.split_corrupt(src.read_events_csv(spark, dirs))
    return good.withColumn("source_file", F.concat(F.regexp_replace("source_dir", "^source_month=", ""),
                                                   F.lit(".csv")))


@query("csv_ingest_profile", raw_sql(FILE_PROFILE_SQL.format(f="source_file")))
def _cip(spark, d):
    return pr.file_profile(_csv_staged(spark, d))


@query("dataset_stats", raw_sql("""SELECT COUNT(*) AS total_rows, COUNT(DISTINCT user_id) AS unique_users,
  COUNT(DISTINCT product_id) AS unique_products, COUNT(DISTINCT user_session) AS unique_sessions,
  MIN(event_time) AS earliest_date, MAX(event_time) AS latest_date FROM rt"""))
def _ds(spark, d):
    return pr.dataset_stats(raw_tagged(spark, d))


MP = """mp AS (SELECT CAST(brand IS NULL AS INTEGER) AS brand_missing, CAST(category_code IS NULL AS INTEGER) AS category_missing,
  COUNT(*) AS "count" FROM rt GROUP BY 1, 2)"""


@query("missing_patterns", raw_sql("""SELECT brand_missing, category_missing, "count",
  CAST("count" AS DOUBLE) / SUM("count") OVER () * 100.0 AS pct FROM mp""", MP))
def _mp(spark, d):
    return pr.missing_patterns(raw_tagged(spark, d))


@query("missing_policy", raw_sql("""SELECT pattern, "rows", pct,
  CASE WHEN pattern = 'both_missing' THEN CASE WHEN pct < 2.0 THEN 'remove' ELSE 'fill' END
       WHEN pattern = 'only_brand_missing' THEN 'fill' ELSE 'infer' END AS decision
FROM (SELECT pattern, "rows", CASE WHEN total > 0 THEN CAST("rows" AS DOUBLE) / total * 100.0 ELSE 0.0 END AS pct
      FROM (SELECT 'both_missing' AS pattern, CAST(SUM(CASE WHEN brand_missing = 1 AND category_missing = 1 THEN "count" ELSE 0 END) AS BIGINT) AS "rows", SUM("count") AS total FROM mp
            UNION ALL SELECT 'only_brand_missing', CAST(SUM(CASE WHEN brand_missing = 1 AND category_missing = 0 THEN "count" ELSE 0 END) AS BIGINT), SUM("count") FROM mp
            UNION ALL SELECT 'only_category_missing', CAST(SUM(CASE WHEN brand_missing = 0 AND category_missing = 1 THEN "count" ELSE 0 END) AS BIGINT), SUM("count") FROM mp) u) v""", MP))
def _mpol(spark, d):
    return pr.missing_policy(pr.missing_patterns(raw_tagged(spark, d)))


@query("event_distribution", with_ev(f"""SELECT event_type, COUNT(*) AS n,
  {rsql('CAST(COUNT(*) AS DOUBLE) * 100.0 / SUM(COUNT(*)) OVER ()')} AS pct FROM ev GROUP BY event_type"""))
def _ed(spark, d):
    return pr.event_distribution(ev_orders(spark, d))


@query("event_distribution_raw", raw_sql("""SELECT event_type, COUNT(*) AS n,
  CAST(COUNT(*) AS DOUBLE) * 100.0 / SUM(COUNT(*)) OVER () AS pct FROM rt GROUP BY event_type"""))
def _edr(spark, d):
    return pr.event_distribution(raw_tagged(spark, d), decimals=None)


@query("hourly_events", with_ev("""SELECT hour, COUNT(*) AS events,
  COUNT(CASE WHEN event_type = 'purchase' THEN 1 END) AS purchases FROM ev GROUP BY hour"""))
def _he(spark, d):
    return pr.hourly_events(ev_orders(spark, d))


@query("brand_performance", with_ev("""SELECT brand, COUNT(*) AS total_events,
  CAST(SUM(brand_was_missing) AS BIGINT) AS was_filled,
  COUNT(CASE WHEN event_type = 'purchase' THEN 1 END) AS purchases
FROM ev WHERE brand != 'Unknown' GROUP BY brand ORDER BY total_events DESC, brand LIMIT 10"""))
def _bp(spark, d):
    return pr.brand_performance(ev_orders(spark, d))


@query("top_brands", raw_sql("""SELECT brand, COUNT(*) AS events FROM rt WHERE brand IS NOT NULL
GROUP BY brand ORDER BY events DESC, brand LIMIT 10"""))
def _tb(spark, d):
    return pr.top_brands(raw_tagged(spark, d))


@query("stream_ingest_clean", with_ev("SELECT * FROM ev"))
def _sic(spark, d):
    """The cleaned events produced by the streaming ingest of the raw CSV
    folders (derived from the tables), read back."""
    from clickspark.streaming.ingest import read_streamed, stream_clean_events
    _csv_staged(spark, d)  # writes the monthly CSV folders
    src_dir = _csv_path(spark, d)
    run = new_path(spark, "clickspark_stream")
    q = stream_clean_events(spark, src_dir, f"{run}/out", f"{run}/chk", bad_dir=f"{run}/bad")
    q.awaitTermination()
    return read_streamed(spark, f"{run}/out")
