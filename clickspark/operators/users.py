"""Users, RFM and behaviour segments, N52-N65.

The user table is aggregated by user_id (partial aggregation absorbs a hot
user), its distinct counts apart from its sums.  Scores that need a position in a global order
(quintiles, top 10 %) use ``ranking.global_rank``: range partitions and
per-partition offsets, never a window without ``partitionBy``.  Scalars
over all users (reference date, p90) are one-row aggregates used as
literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickspark.functions.numeric import (
    exact_avg, exact_sum, micros, round_np, round_sql, whole_days_between,
)
from clickspark.operators.ranking import global_rank, qcut_rank, qcut_ranks, quantiles

_is = lambda t: F.col("event_type") == t


def _distinct_count(ev: DataFrame, value: Column, out: str) -> DataFrame:
    """Per user the number of different non-null values."""
    return (ev.select("user_id", value.alias("_v")).where(F.col("_v").isNotNull()).distinct()
              .groupBy("user_id").agg(F.count(F.lit(1)).alias(out)))


def user_table(ev: DataFrame) -> DataFrame:
    """Per user first/last event, sessions (= active days), events,
    views / carts / purchases, revenue, mean order value (2 dp, null without
    purchases), active days and distinct products.

    The two distinct counts are aggregations of their own, joined by user: in
    one aggregation with the sums every event becomes three rows, each with a
    buffer for all sums, keyed nearly uniquely."""
    known = ev.where(F.col("user_id").isNotNull())
    g = known.groupBy("user_id").agg(
        F.min("event_time").alias("first_event"),
        F.max("event_time").alias("last_event"),
        F.count("*").alias("total_events"),
        F.count(F.when(_is("view"), 1)).alias("total_views"),
        F.count(F.when(_is("cart"), 1)).alias("total_carts"),
        F.count(F.when(_is("purchase"), 1)).alias("total_purchases"),
        F.coalesce(exact_sum("price", _is("purchase")), F.lit(0.0)).alias("total_revenue"),
        round_sql(exact_avg("price", _is("purchase")), 2).alias("avg_order_value"))
    # a user without any day or product has no row there
    days = _distinct_count(known, F.to_date("event_time"), "_days")
    products = _distinct_count(known, F.col("product_id"), "_products")
    sessions = F.coalesce("_days", F.lit(0))
    return (g.join(days, "user_id", "left").join(products, "user_id", "left")
             .select("user_id", "first_event", "last_event", sessions.alias("total_sessions"), "total_events",
                     "total_views", "total_carts", "total_purchases", "total_revenue",
                     "avg_order_value", sessions.alias("days_active"),
                     F.coalesce("_products", F.lit(0)).alias("unique_products_viewed")))


def user_level_features(ev: DataFrame) -> DataFrame:
    """Per user events, views / carts / purchases, distinct products and
    active span (seconds)."""
    g = ev.groupBy("user_id").agg(
        F.count("*").alias("total_events"),
        F.count(F.when(_is("view"), 1)).alias("views"),
        F.count(F.when(_is("cart"), 1)).alias("carts"),
        F.count(F.when(_is("purchase"), 1)).alias("purchases"),
        F.countDistinct("product_id").alias("unique_products"),
        F.min("event_time").alias("_a"), F.max("event_time").alias("_b"))
    return g.select("user_id", "total_events", "views", "carts", "purchases", "unique_products",
                    ((micros("_b") - micros("_a")).cast("double") / F.lit(1e6)).alias("active_span_sec"))


def rfm_values(usr: DataFrame) -> DataFrame:
    """Purchasers with Recency (whole days before the latest event of
    *all* users), Frequency (purchases) and Monetary (revenue)."""
    ref = usr.agg(F.max("last_event").alias("m")).first()["m"]
    return (usr.where(F.col("total_purchases") > 0)
               .withColumn("Recency", whole_days_between(F.col("last_event"), F.lit(ref)))
               .withColumn("Frequency", F.col("total_purchases"))
               .withColumn("Monetary", F.col("total_revenue")))


def score_quintile(df: DataFrame, col: str, ascending_good: bool = True, out: str | None = None,
                   q: int = 5) -> DataFrame:
    """1..q equal-frequency score of ``col`` by unique rank (ties by
    user_id); reversed (q+1-bin) when lower is better."""
    return qcut_rank(df, col, q, tie=("user_id",), out=out or f"{col}_score",
                     descending_good=not ascending_good)


def rfm_scores(rfm: DataFrame) -> DataFrame:
    """R (reversed), F, M quintile scores and the concatenated string;
    the three rankings run as one pass (``ranking.qcut_ranks``)."""
    s = qcut_ranks(rfm, [("Recency", "R_Score", True), ("Frequency", "F_Score", False),
                         ("Monetary", "M_Score", False)], 5, tie=("user_id",))
    return s.withColumn("RFM_Score", F.concat(F.col("R_Score").cast("string"),
                                              F.col("F_Score").cast("string"),
                                              F.col("M_Score").cast("string")))


def rfm_segment_expr(r: Column, f: Column, m: Column) -> Column:
    """The reference's ordered RFM rules; first match wins."""
    return (F.when((r >= 4) & (f >= 4) & (m >= 4), "Champions")
             .when((r >= 3) & (f >= 4) & (m >= 3), "Loyal Customers")
             .when((r >= 4) & (f >= 2) & (m >= 2), "Potential Loyalists")
             .when((r >= 4) & (f <= 2), "New Customers")
             .when((r <= 2) & (f >= 4) & (m >= 3), "Can't Lose Them")
             .when((r <= 2) & (f >= 3), "At Risk")
             .when((r <= 2) & (f <= 2), "Hibernating")
             .when(m <= 2, "Price Sensitive")
             .otherwise("Others"))


def rfm_segment(scores: DataFrame) -> DataFrame:
    """Named RFM segment per purchaser."""
    return scores.withColumn("Segment", rfm_segment_expr(F.col("R_Score"), F.col("F_Score"),
                                                         F.col("M_Score")))


def _distribution(df: DataFrame, col: str) -> DataFrame:
    """Users per label with share % (pandas rounding), by count desc.  The
    total is a window over the grouped rows (one per label)."""
    from pyspark.sql import Window
    g = df.groupBy(F.col(col).alias("Segment")).agg(F.count("*").alias("User_Count"))
    tot = F.sum("User_Count").over(Window.partitionBy())
    return (g.select("Segment", "User_Count",
                     round_np(F.col("User_Count") / tot * F.lit(100.0), 2).alias("Percentage"))
             .orderBy(F.desc("User_Count"), "Segment"))


def rfm_segment_distribution(seg: DataFrame) -> DataFrame:
    """Purchasers per RFM segment with %."""
    return _distribution(seg, "Segment")


def rfm_segment_characteristics(seg: DataFrame) -> DataFrame:
    """Per segment users, mean R / F / M, total revenue, mean sessions
    and active days (2 dp), by total revenue desc."""
    n = F.count("*")
    g = seg.groupBy("Segment").agg(
        n.alias("User_Count"),
        round_np(F.sum("Recency").cast("double") / n, 2).alias("Avg_Recency_Days"),
        round_np(F.sum("Frequency").cast("double") / n, 2).alias("Avg_Frequency"),
        round_np(exact_sum("Monetary") / n, 2).alias("Avg_Monetary"),
        round_np(exact_sum("Monetary"), 2).alias("Total_Revenue"),
        round_np(F.sum("total_sessions").cast("double") / n, 2).alias("Avg_Sessions"),
        round_np(F.sum("days_active").cast("double") / n, 2).alias("Avg_Days_Active"))
    return g.orderBy(F.desc("Total_Revenue"), "Segment")


def clv_insights(rfm: DataFrame) -> DataFrame:
    """Purchasers, revenue, mean / median value, revenue of the top
    10 % (k = max(1, int(0.1 n)) users) and its share, mean purchases and
    mean active days."""
    a = rfm.agg(F.count("*").alias("total_purchasing_users"),
                exact_sum("Monetary").alias("total_revenue"),
                F.sum("Frequency").alias("_f"), F.sum("days_active").alias("_d")).first()
    n = a["total_purchasing_users"]
    k = max(1, int(n * 0.1))
    # one ranking (Monetary desc) serves both the top-k sum and the median:
    # ascending position i (0-based) is descending rank n - i
    r = global_rank(rfm.select("user_id", "Monetary"),
                    [F.col("Monetary").desc(), F.col("user_id").asc()], rank_col="_rn", count_col="_n")
    pos = (n - 1) * 0.5
    lo_rank, hi_rank = n - int(pos // 1), n - int(-(-pos // 1))
    frac = pos - (pos // 1)
    s = r.where((F.col("_rn") <= k) | F.col("_rn").isin(lo_rank, hi_rank)).agg(
        exact_sum("Monetary", F.col("_rn") <= k).alias("top"),
        F.max(F.when(F.col("_rn") == lo_rank, F.col("Monetary"))).alias("lo"),
        F.max(F.when(F.col("_rn") == hi_rank, F.col("Monetary"))).alias("hi")).first()
    top_sum = s["top"]
    lo, hi = s["lo"], s["hi"]
    med = None if lo is None else (hi - (hi - lo) * (1 - frac) if frac >= 0.5 else lo + (hi - lo) * frac)
    tot = a["total_revenue"]
    # one-row aggregate of the purchasers carrying the scalars above
    return rfm.agg(F.count("*").alias("total_purchasing_users")).select(
        F.col("total_purchasing_users").cast("long").alias("total_purchasing_users"),
        F.lit(tot).cast("double").alias("total_revenue"),
        (F.lit(tot).cast("double") / F.lit(n)).alias("avg_customer_value"),
        F.lit(med).cast("double").alias("median_customer_value"),
        F.lit(top_sum).cast("double").alias("top_10_percent_revenue"),
        (F.lit(top_sum).cast("double") / F.lit(tot) * 100).alias("top_10_percent_share"),
        (F.lit(a["_f"]).cast("double") / F.lit(n)).alias("avg_purchases_per_user"),
        (F.lit(a["_d"]).cast("double") / F.lit(n)).alias("avg_days_active"))


def power_users(usr: DataFrame, materialize: bool = True) -> DataFrame:
    """``is_power_user`` = total events strictly above the 90th
    percentile of all users (interpolated).  ``materialize=False`` when
    ``usr`` is already a written table (the quantile passes re-read it)."""
    p90 = quantiles(usr, "total_events", [0.9], ["p90"], materialize=materialize).first()["p90"]
    return usr.withColumn("is_power_user", (F.col("total_events") > F.lit(p90)).cast("int"))


def behavioral_segment_expr() -> Column:
    return (F.when(F.col("total_purchases") > 0, "Buyers")
             .when(F.col("total_carts") > 0, "Cart Abandoners")
             .when(F.col("total_views") > 50, "Window Shoppers")
             .when(F.col("total_events") <= 5, "Casual Browsers")
             .otherwise("Active Browsers"))


def behavioral_segment(usr: DataFrame) -> DataFrame:
    """All-user behaviour segment, first match wins."""
    return usr.withColumn("Behavioral_Segment", behavioral_segment_expr())


def behavioral_distribution(seg: DataFrame) -> DataFrame:
    """Users per behaviour segment with %."""
    return _distribution(seg, "Behavioral_Segment")


def power_user_summary(seg: DataFrame) -> DataFrame:
    """Power users per behaviour segment."""
    return (seg.groupBy("Behavioral_Segment")
               .agg(F.sum("is_power_user").cast("long").alias("Power_User_Count"))
               .orderBy("Behavioral_Segment"))
