"""Daily-proxy sessions N31-N43: one session = one user on one calendar day.

The session table is one aggregation keyed by (user_id, session_date):
partial aggregation map-side, one shuffle; a hot user is split over its
days.  Every analysis over it is a small aggregation whose output has a
handful of rows.  Durations are summed as exact microseconds so means do
not depend on the order partitions are combined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickspark.functions.numeric import (
    exact_avg, exact_sum, flag, micros, minute_boundaries, round_sql,
)

_is = lambda t: F.col("event_type") == t


def session_table(ev: DataFrame) -> DataFrame:
    """Per user x date session with start/end, fractional minutes,
    counts, distinct products, stage flags, revenue, prices, weekend flag
    and start hour.  Rows with null user or time are dropped."""
    base = ev.where(F.col("user_id").isNotNull() & F.col("event_time").isNotNull())
    sd = F.to_date("event_time")
    g = base.groupBy("user_id", sd.alias("session_date")).agg(
        F.min("event_time").alias("session_start"),
        F.max("event_time").alias("session_end"),
        F.count("*").alias("total_events"),
        F.countDistinct("product_id").alias("unique_products_viewed"),
        F.count(F.when(_is("view"), 1)).alias("view_count"),
        F.count(F.when(_is("cart"), 1)).alias("cart_count"),
        F.count(F.when(_is("purchase"), 1)).alias("purchase_count"),
        F.max(flag(_is("purchase"))).alias("has_purchase"),
        F.max(flag(_is("cart"))).alias("has_cart"),
        F.coalesce(exact_sum("price", _is("purchase")), F.lit(0.0)).alias("total_revenue"),
        round_sql(exact_avg("price"), 2).alias("avg_product_price"),
        F.max("price").alias("max_price_viewed"),
        F.max("is_weekend").alias("is_weekend_session"))
    return g.select(
        "user_id", "session_date",
        F.concat(F.col("user_id").cast("string"), F.lit("_"), F.col("session_date").cast("string")).alias("session_id"),
        "session_start", "session_end",
        ((micros("session_end") - micros("session_start")) / F.lit(60000000.0)).alias("session_duration_minutes"),
        "total_events", "unique_products_viewed", "view_count", "cart_count", "purchase_count",
        "has_purchase", "has_cart", "total_revenue", "avg_product_price", "max_price_viewed",
        "is_weekend_session", F.hour("session_start").cast("int").alias("session_start_hour"))


def _dur_us() -> Column:
    return micros("session_end") - micros("session_start")


def avg_minutes() -> Column:
    """Mean session minutes from exact microsecond sums."""
    return F.sum(_dur_us()).cast("double") / F.count("*") / F.lit(60000000.0)


def _conv() -> Column:
    return round_sql(F.sum("has_purchase") * F.lit(100.0) / F.count("*"), 2)


def _finish(df: DataFrame, order: list[Column], key: list[Column], drop: tuple = (),
            ordered: bool = True) -> DataFrame:
    """Order a small result; ``ordered=False`` instead returns the rows with
    a sortable ``_order`` key (for callers that sort elsewhere, e.g. inside
    an array), saving the range-partitioned sort."""
    if ordered:
        return df.orderBy(*order).drop(*drop)
    return df.withColumn("_order", F.struct(*key)).drop(*drop)


def session_summary(ses: DataFrame) -> DataFrame:
    """Sessions, users, mean minutes / events / products (2 dp),
    purchase sessions and their rate %."""
    return ses.agg(
        F.count("*").alias("total_sessions"),
        F.countDistinct("user_id").alias("total_users"),
        round_sql(avg_minutes(), 2).alias("avg_session_duration_min"),
        round_sql(F.avg("total_events"), 2).alias("avg_events_per_session"),
        round_sql(F.avg("unique_products_viewed"), 2).alias("avg_products_per_session"),
        F.sum("has_purchase").cast("long").alias("sessions_with_purchase"),
        _conv().alias("purchase_session_rate"))


def session_behavior_comparison(ses: DataFrame, ordered: bool = True) -> DataFrame:
    """Purchase vs non-purchase sessions."""
    return _finish(ses.groupBy("has_purchase").agg(
                F.count("*").alias("session_count"),
                round_sql(avg_minutes(), 2).alias("avg_duration_min"),
                round_sql(F.avg("total_events"), 2).alias("avg_events"),
                round_sql(F.avg("unique_products_viewed"), 2).alias("avg_products_viewed"))
            .select(F.when(F.col("has_purchase") == 1, "Purchase Session")
                     .otherwise("Non-Purchase Session").alias("session_type"),
                    "session_count", "avg_duration_min", "avg_events", "avg_products_viewed"),
                   [F.col("session_type")], [F.col("session_type")], ordered=ordered)


# Fixed bucket labels and edges of the reference's session breakdowns.
DURATION_BUCKETS = [(1, "< 1 min"), (5, "1-5 min"), (15, "5-15 min"), (30, "15-30 min"),
                    (60, "30-60 min")]
DURATION_LAST = "60+ min"
PRODUCT_BUCKETS = [(1, 1, "1 product"), (2, 3, "2-3 products"), (4, 5, "4-5 products"),
                   (6, 10, "6-10 products"), (11, 20, "11-20 products")]
PRODUCT_LAST = "20+ products"
ENGAGEMENT_BUCKETS = [(1, 1, "Bounce (1 event)"), (2, 3, "Low (2-3 events)"),
                      (4, 10, "Medium (4-10 events)"), (11, 20, "High (11-20 events)")]
ENGAGEMENT_LAST = "Very High (20+ events)"


def _left_closed(col: str, buckets, last: str) -> tuple[Column, Column]:
    c = F.col(col)
    lab = F.lit(last)
    order = F.lit(len(buckets) + 1)
    for i in range(len(buckets) - 1, -1, -1):
        edge, name = buckets[i]
        lab = F.when(c < edge, F.lit(name)).otherwise(lab)
        order = F.when(c < edge, F.lit(i + 1)).otherwise(order)
    return lab, order


def _between(col: str, buckets, last: str) -> tuple[Column, Column]:
    c = F.col(col)
    lab = F.lit(last)
    order = F.lit(len(buckets) + 1)
    for i in range(len(buckets) - 1, -1, -1):
        lo, hi, name = buckets[i]
        lab = F.when(c.between(lo, hi), F.lit(name)).otherwise(lab)
        order = F.when(c.between(lo, hi), F.lit(i + 1)).otherwise(order)
    return lab, order


def session_duration_distribution(ses: DataFrame, ordered: bool = True) -> DataFrame:
    """Left-closed duration buckets with conversion."""
    lab, order = _left_closed("session_duration_minutes", DURATION_BUCKETS, DURATION_LAST)
    g = ses.groupBy(lab.alias("duration_bucket"), order.alias("bucket_order")).agg(
        F.count("*").alias("session_count"),
        F.sum("has_purchase").cast("long").alias("sessions_with_purchase"),
        _conv().alias("conversion_rate"))
    return _finish(g, [F.col("bucket_order")], [F.col("bucket_order")], ("bucket_order",), ordered)


def products_per_session(ses: DataFrame, ordered: bool = True) -> DataFrame:
    """Distinct-product buckets (0 falls in the last bucket)."""
    lab, order = _between("unique_products_viewed", PRODUCT_BUCKETS, PRODUCT_LAST)
    g = ses.groupBy(lab.alias("products_bucket"), order.alias("bucket_order")).agg(
        F.count("*").alias("session_count"),
        F.sum("has_purchase").cast("long").alias("purchases"),
        _conv().alias("conversion_rate"))
    return _finish(g, [F.col("bucket_order")], [F.col("bucket_order")], ("bucket_order",), ordered)


def session_cart_abandonment(ses: DataFrame, ordered: bool = True) -> DataFrame:
    """Abandoned / converted / no-cart sessions with share of all."""
    st = (F.when((F.col("has_cart") == 1) & (F.col("has_purchase") == 0), "Cart Abandoned")
           .when((F.col("has_cart") == 1) & (F.col("has_purchase") == 1), "Cart Converted")
           .otherwise("No Cart Activity"))
    g = ses.groupBy(st.alias("cart_status")).agg(F.count("*").alias("session_count"))
    # window over the (at most three) grouped rows
    tot = F.sum("session_count").over(Window.partitionBy())
    r = g.select("cart_status", "session_count",
                 round_sql(F.col("session_count") * F.lit(100.0) / tot, 2).alias("percentage"))
    return _finish(r, [F.desc("session_count"), F.col("cart_status")],
                   [-F.col("session_count"), F.col("cart_status")], ordered=ordered)


def session_engagement(ses: DataFrame, ordered: bool = True) -> DataFrame:
    """Engagement levels by events per session."""
    lab, order = _between("total_events", ENGAGEMENT_BUCKETS, ENGAGEMENT_LAST)
    g = ses.groupBy(lab.alias("engagement_level"), order.alias("bucket_order")).agg(
        F.count("*").alias("session_count"),
        F.sum("has_purchase").cast("long").alias("purchases"),
        round_sql(avg_minutes(), 2).alias("avg_duration"),
        _conv().alias("conversion_rate"))
    return _finish(g, [F.col("bucket_order")], [F.col("bucket_order")], ("bucket_order",), ordered)


def hourly_session_patterns(ses: DataFrame, ordered: bool = True) -> DataFrame:
    """Sessions by start hour."""
    return _finish(ses.groupBy(F.col("session_start_hour").alias("hour")).agg(
                F.count("*").alias("total_sessions"),
                F.sum("has_purchase").cast("long").alias("sessions_with_purchase"),
                _conv().alias("conversion_rate"),
                round_sql(avg_minutes(), 2).alias("avg_duration_min")),
                   [F.col("hour")], [F.col("hour")], ordered=ordered)


def weekend_weekday_sessions(ses: DataFrame, ordered: bool = True) -> DataFrame:
    """Sessions by weekend flag."""
    return _finish(ses.groupBy("is_weekend_session").agg(
                F.count("*").alias("session_count"),
                F.sum("has_purchase").cast("long").alias("sessions_with_purchase"),
                _conv().alias("conversion_rate"),
                round_sql(avg_minutes(), 2).alias("avg_duration"),
                round_sql(F.avg("total_events"), 2).alias("avg_events"),
                round_sql(F.avg("unique_products_viewed"), 2).alias("avg_products"))
            .select(F.when(F.col("is_weekend_session") == 1, "Weekend").otherwise("Weekday").alias("day_type"),
                    "session_count", "sessions_with_purchase", "conversion_rate",
                    "avg_duration", "avg_events", "avg_products"),
                   [F.col("day_type")], [F.col("day_type")], ordered=ordered)


def sessions_basic(ev: DataFrame) -> DataFrame:
    """User x day sessions with start, end and stage counts (all
    events, as the notebook's session table)."""
    return ev.groupBy("user_id", F.date_trunc("day", "event_time").alias("session_day")).agg(
        F.min("event_time").alias("session_start"),
        F.max("event_time").alias("session_end"),
        F.count("*").alias("event_count"),
        F.count(F.when(_is("view"), 1)).alias("views"),
        F.count(F.when(_is("cart"), 1)).alias("carts"),
        F.count(F.when(_is("purchase"), 1)).alias("purchases"))


def session_stats(sb: DataFrame) -> DataFrame:
    """Sessions, mean events (1 dp), mean minute boundaries crossed
    (``DATEDIFF('minute')``, 1 dp)."""
    return sb.agg(
        F.count("*").alias("total_sessions"),
        round_sql(F.avg("event_count"), 1).alias("avg_events_per_session"),
        round_sql(F.avg(minute_boundaries("session_start", "session_end")), 1).alias("avg_session_minutes"))


def session_approximation(ev: DataFrame) -> DataFrame:
    """User x day events and purchases."""
    return ev.groupBy("user_id", F.date_trunc("day", "event_time").alias("session_day")).agg(
        F.count("*").alias("events"),
        F.count(F.when(_is("purchase"), 1)).alias("purchases"))
