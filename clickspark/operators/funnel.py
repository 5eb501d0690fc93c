"""Funnels N8-N30: raw and deduplicated (user x product) view -> cart ->
purchase conversion, overall and by category, brand, hour, weekend, month,
price tier; plus the user-level funnel.

Shape of the deduplicated funnels: one aggregation to the (user, product
[, dim]) grain (partial aggregation map-side, one shuffle on the pair key,
which spreads a hot user over its products), then one aggregation to the
dimension grain (tiny after the partial step, so a hot dimension value such
as 'Unknown' costs one row per map task).  Per-dimension extras (raw counts,
price sums) ride along in the same two aggregations instead of a second scan
and a join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from clickspark.functions.numeric import (
    count_when, exact_parts, exact_value, merge_parts, ratio_or_null, ratio_or_zero,
)

_is = lambda t: F.col("event_type") == t


def _stage_max(t: str) -> Column:
    return F.max(_is(t).cast("int"))


def pair_flags(ev: DataFrame, dims: Sequence[str] = ()) -> DataFrame:
    """Did each user x product [x dims] reach view / cart / purchase."""
    return (ev.groupBy("user_id", "product_id", *dims)
              .agg(_stage_max("view").alias("viewed"),
                   _stage_max("cart").alias("carted"),
                   _stage_max("purchase").alias("purchased")))


def _rates(v: str, c: str, p: str) -> list[Column]:
    return [ratio_or_null(c, v).alias("view_to_cart"),
            ratio_or_null(p, c).alias("cart_to_purchase"),
            ratio_or_null(p, v).alias("view_to_purchase")]


def funnel_dedup(ev: DataFrame) -> DataFrame:
    """Stage sums over user-product pairs, with the three rates."""
    s = pair_flags(ev).agg(
        F.sum("viewed").cast("long").alias("views_unique"),
        F.sum("carted").cast("long").alias("carts_unique"),
        F.sum("purchased").cast("long").alias("purchases_unique"))
    return s.select("*", *_rates("views_unique", "carts_unique", "purchases_unique"))


def funnel_raw(ev: DataFrame) -> DataFrame:
    """Stage counts over all events, with the three rates (column names
    as in the reference's saved summary)."""
    s = ev.agg(count_when(_is("view")).alias("views_unique"),
               count_when(_is("cart")).alias("carts_unique"),
               count_when(_is("purchase")).alias("purchases_unique"))
    return s.select("*", *_rates("views_unique", "carts_unique", "purchases_unique"))


def funnel_dropoff(funnel: DataFrame) -> DataFrame:
    """Drop-off % between stages; a zero stage gives rate 0, so 100 %."""
    return funnel.select(
        ((F.lit(1.0) - ratio_or_zero("carts_unique", "views_unique")) * 100).alias("dropoff_view_to_cart_pct"),
        ((F.lit(1.0) - ratio_or_zero("purchases_unique", "carts_unique")) * 100).alias("dropoff_cart_to_purchase_pct"))


def _dim_sums(pairs: DataFrame, dims: Sequence[str], extra: Sequence[Column] = ()) -> DataFrame:
    return pairs.groupBy(*dims).agg(
        F.sum("viewed").cast("long").alias("viewed"),
        F.sum("carted").cast("long").alias("carted"),
        F.sum("purchased").cast("long").alias("purchased"), *extra)


def category_funnel(ev: DataFrame) -> DataFrame:
    """Deduplicated stages per category_code and two rates."""
    d = _dim_sums(pair_flags(ev, ["category_code"]), ["category_code"])
    return d.select("*", ratio_or_null("carted", "viewed").alias("view_to_cart"),
                    ratio_or_null("purchased", "carted").alias("cart_to_purchase"))


def brand_funnel(ev: DataFrame) -> DataFrame:
    """Deduplicated stages per brand, three rates, two drop-offs and the
    brand's mean price over all its events; ordered by drop_view_cart."""
    pairs = (ev.groupBy("user_id", "product_id", "brand")
               .agg(_stage_max("view").alias("viewed"),
                    _stage_max("cart").alias("carted"),
                    _stage_max("purchase").alias("purchased"),
                    exact_parts("price").alias("_psum"),
                    F.count("price").alias("_pcnt")))
    d = _dim_sums(pairs, ["brand"], [merge_parts("_psum").alias("_psum"), F.sum("_pcnt").alias("_pcnt")])
    return (d.select("brand", "viewed", "carted", "purchased",
                     *_rates("viewed", "carted", "purchased"),
                     (F.lit(1.0) - ratio_or_null("carted", "viewed")).alias("drop_view_cart"),
                     (F.lit(1.0) - ratio_or_null("purchased", "carted")).alias("drop_cart_purchase"),
                     ratio_or_null(exact_value("_psum"), "_pcnt").alias("avg_price"))
             .orderBy(F.col("drop_view_cart").asc_nulls_last(), "brand"))


def hourly_funnel(ev: DataFrame) -> DataFrame:
    """Deduplicated (user, product, hour) stages per hour, 3 rates."""
    d = _dim_sums(pair_flags(ev, ["hour"]), ["hour"])
    return d.select("*", *_rates("viewed", "carted", "purchased")).orderBy("hour")


def brand_analysis(ev: DataFrame) -> DataFrame:
    """Raw stage counts per brand, conversion, drop-offs, mean price:
    one aggregation (the reference's second scan + join folds into it)."""
    d = ev.groupBy("brand").agg(
        count_when(_is("view")).alias("view"),
        count_when(_is("cart")).alias("cart"),
        count_when(_is("purchase")).alias("purchase"),
        exact_parts("price").alias("_psum"),
        F.count("price").alias("_pcnt"))
    return (d.select("brand", "view", "cart", "purchase",
                     ratio_or_null("purchase", "view").alias("conversion_rate"),
                     (F.lit(1.0) - ratio_or_null("cart", "view")).alias("drop_view_cart"),
                     (F.lit(1.0) - ratio_or_null("purchase", "cart")).alias("drop_cart_purchase"),
                     ratio_or_null(exact_value("_psum"), "_pcnt").alias("avg_price"))
             .orderBy(F.col("conversion_rate").desc_nulls_last(), "brand"))


def pair_cart_abandonment(ev: DataFrame, strict: bool = False) -> DataFrame:
    """``(Σcarted − Σpurchased) / Σcarted`` over user-product pairs.
    As in the reference this subtracts every purchased pair, carted or not,
    so it can be negative; ``strict=True`` counts carted-and-not-purchased
    pairs instead."""
    p = pair_flags(ev)
    if strict:
        num = F.sum(((F.col("carted") == 1) & (F.col("purchased") == 0)).cast("int"))
        s = p.agg(F.sum("carted").cast("long").alias("total_carts"),
                  F.sum("purchased").cast("long").alias("total_purchases"),
                  num.cast("long").alias("_ab"))
        return s.select("total_carts", "total_purchases",
                        ratio_or_null("_ab", "total_carts").alias("abandonment_rate"))
    s = p.agg(F.sum("carted").cast("long").alias("total_carts"),
              F.sum("purchased").cast("long").alias("total_purchases"))
    return s.select("*", ratio_or_null(F.col("total_carts") - F.col("total_purchases"),
                                       "total_carts").alias("abandonment_rate"))


def category_event_counts(ev: DataFrame) -> DataFrame:
    """Raw views / carts / purchases per category_code."""
    return ev.groupBy("category_code").agg(
        count_when(_is("view")).alias("views_raw"),
        count_when(_is("cart")).alias("carts_raw"),
        count_when(_is("purchase")).alias("purchases_raw"))


def combined_category_funnel(ev: DataFrame) -> DataFrame:
    """Deduplicated category funnel joined with raw counts; raw counts
    ride along in the pair aggregation (same scan, no join).  Sorted by
    purchased, descending."""
    pairs = (ev.groupBy("user_id", "product_id", "category_code")
               .agg(_stage_max("view").alias("viewed"),
                    _stage_max("cart").alias("carted"),
                    _stage_max("purchase").alias("purchased"),
                    count_when(_is("view")).alias("_vr"),
                    count_when(_is("cart")).alias("_cr"),
                    count_when(_is("purchase")).alias("_pr")))
    d = _dim_sums(pairs, ["category_code"], [
        F.sum("_vr").cast("long").alias("views_raw"),
        F.sum("_cr").cast("long").alias("carts_raw"),
        F.sum("_pr").cast("long").alias("purchases_raw")])
    v2p = ratio_or_null("purchased", "viewed")
    return (d.select("category_code", "viewed", "carted", "purchased",
                     ratio_or_null("carted", "viewed").alias("view_to_cart"),
                     ratio_or_null("purchased", "carted").alias("cart_to_purchase"),
                     "views_raw", "carts_raw", "purchases_raw",
                     v2p.alias("view_to_purchase"),
                     ratio_or_null("carts_raw", "views_raw").alias("event_view_to_cart"),
                     ratio_or_null("purchases_raw", "carts_raw").alias("event_cart_to_purchase"),
                     F.col("views_raw").alias("traffic"),
                     v2p.alias("conversion"))
             .orderBy(F.desc("purchased"), "category_code"))


def _period(col: str = "is_weekend") -> Column:
    return F.when(F.col(col) == 1, "Weekend").otherwise("Weekday")


def weekend_funnel(ev: DataFrame) -> DataFrame:
    """Deduplicated (user, product, weekend) stages per period."""
    d = _dim_sums(pair_flags(ev, ["is_weekend"]), ["is_weekend"])
    return (d.select(_period().alias("period"),
                     F.col("viewed").alias("views"), F.col("carted").alias("carts"),
                     F.col("purchased").alias("purchases"),
                     *_rates("viewed", "carted", "purchased"), "is_weekend")
             .orderBy("is_weekend").drop("is_weekend"))


def hourly_weekend_funnel(ev: DataFrame) -> DataFrame:
    """Deduplicated (user, product, hour, weekend) stages per hour x
    period."""
    d = _dim_sums(pair_flags(ev, ["hour", "is_weekend"]), ["hour", "is_weekend"])
    return (d.select("hour", _period().alias("period"),
                     F.col("viewed").alias("views"), F.col("carted").alias("carts"),
                     F.col("purchased").alias("purchases"),
                     *_rates("viewed", "carted", "purchased"), "is_weekend")
             .orderBy("hour", "is_weekend").drop("is_weekend"))


def monthly_funnel(ev: DataFrame) -> DataFrame:
    """Raw counts and three rates per calendar month (month as date)."""
    d = ev.groupBy(F.trunc(F.col("event_time").cast("date"), "month").alias("month")).agg(
        count_when(_is("view")).alias("views"),
        count_when(_is("cart")).alias("carts"),
        count_when(_is("purchase")).alias("purchases"))
    return d.select("*", *_rates("views", "carts", "purchases")).orderBy("month")


def hour_period_matrix(hw: DataFrame, value: str = "view_to_purchase") -> DataFrame:
    """Hour x period pivot of a rate from ``hourly_weekend_funnel``."""
    return (hw.groupBy("hour").pivot("period", ["Weekday", "Weekend"])
              .agg(F.max(value)).orderBy("hour"))


def top_categories(cf: DataFrame, by: str = "purchased", k: int = 10,
                   ascending: bool = False) -> DataFrame:
    """Top (or bottom) k categories of a category funnel by a column;
    ties broken by category_code.  Planned as TakeOrderedAndProject (each
    task keeps k rows)."""
    o = F.col(by).asc() if ascending else F.col(by).desc()
    return cf.orderBy(o, F.col("category_code").asc()).limit(k)


def category_traffic_histogram(counts: DataFrame, col: str = "views_raw", bins: int = 20) -> DataFrame:
    """Equal-width histogram of a per-category count (numpy rules: edges
    from min to max, last bin closed; min == max widens the range by 0.5 on
    each side).  Bin index in exact integer arithmetic.  min / max are one
    aggregate row fetched as scalars."""
    st = counts.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    spark = counts.sparkSession
    if st is None or st["lo"] is None:
        return spark.createDataFrame([], "bin int, bin_start double, bin_end double, count long")
    lo, hi = int(st["lo"]), int(st["hi"])
    a, b = (lo - 0.5, hi + 0.5) if hi == lo else (float(lo), float(hi))
    if hi == lo:
        idx = F.lit(bins // 2)
    else:
        idx = F.least(F.lit(bins - 1),
                      F.floor((F.col(col).cast("long") - lo) * bins / F.lit(hi - lo)).cast("int"))
    cnt = counts.groupBy((idx + 1).cast("int").alias("bin")).agg(F.count("*").alias("count"))
    spine = spark.range(bins).select(
        (F.col("id") + 1).cast("int").alias("bin"),
        (F.lit(a) + F.lit(b - a) * F.col("id") / bins).alias("bin_start"),
        (F.lit(a) + F.lit(b - a) * (F.col("id") + 1) / bins).alias("bin_end"))
    return (spine.join(cnt, "bin", "left")
                 .select("bin", "bin_start", "bin_end",
                         F.coalesce("count", F.lit(0)).cast("long").alias("count"))
                 .orderBy("bin"))


def user_funnel(ev: DataFrame) -> DataFrame:
    """Users who viewed / carted / purchased, cart abandoners, and the
    rates (cart and purchase rates over the previous stage, overall over all
    users), as percentages."""
    u = ev.groupBy("user_id").agg(
        _stage_max("view").alias("did_view"),
        _stage_max("cart").alias("did_cart"),
        _stage_max("purchase").alias("did_purchase"))
    s = u.agg(F.count("*").alias("total_users"),
              F.sum("did_view").cast("long").alias("viewed"),
              F.sum("did_cart").cast("long").alias("carted"),
              F.sum("did_purchase").cast("long").alias("purchased"),
              F.sum(((F.col("did_cart") == 1) & (F.col("did_purchase") == 0)).cast("int"))
               .cast("long").alias("cart_abandoners"))
    pct = lambda a, b: (ratio_or_null(a, b) * 100)
    return s.select("*",
                    pct("viewed", "total_users").alias("view_rate_pct"),
                    pct("carted", "viewed").alias("cart_rate_pct"),
                    pct("purchased", "carted").alias("purchase_rate_pct"),
                    pct("purchased", "total_users").alias("overall_cvr_pct"),
                    pct("cart_abandoners", "carted").alias("cart_abandonment_pct"))


# Default price tiers (left-closed edges); the reference names a price-tier
# breakdown without code, so edges are a parameter.
PRICE_TIER_EDGES = (0.0, 50.0, 250.0, 1000.0, 10000.0)


def price_tier(edges: Sequence[float] = PRICE_TIER_EDGES) -> Column:
    """Label of the left-closed tier ``[e_i, e_{i+1})`` of the price; the
    last tier is open-ended, prices below the first edge get null."""
    p = F.col("price")
    last = len(edges) - 1
    expr = F.when(p >= edges[last], F.lit(f"{edges[last]:g}+"))
    for i in range(last - 1, -1, -1):
        expr = F.when((p >= edges[i]) & (p < edges[i + 1]),
                      F.lit(f"{edges[i]:g}-{edges[i + 1]:g}")).otherwise(expr)
    return expr


def price_tier_funnel(ev: DataFrame, edges: Sequence[float] = PRICE_TIER_EDGES) -> DataFrame:
    """Deduplicated funnel per price tier (tier of each event's price)."""
    tiered = ev.withColumn("price_tier", price_tier(edges))
    d = _dim_sums(pair_flags(tiered, ["price_tier"]), ["price_tier"])
    return d.select("*", *_rates("viewed", "carted", "purchased")).orderBy("price_tier")


def funnel_event_counts(ev: DataFrame) -> DataFrame:
    """Events per type in funnel order (view, cart, purchase, others)
    with the guarded view->cart and cart->purchase percentages.  The totals
    are windows over the grouped rows (one per event type)."""
    c = ev.groupBy("event_type").agg(F.count("*").alias("count"))
    allw = Window.partitionBy()
    stage = lambda t: F.sum(F.when(F.col("event_type") == t, F.col("count")).otherwise(0)).over(allw)
    order = (F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "cart", 2)
              .when(F.col("event_type") == "purchase", 3).otherwise(4))
    return (c.select("event_type", "count",
                     (ratio_or_zero(stage("cart"), stage("view")) * 100).alias("view_to_cart_pct"),
                     (ratio_or_zero(stage("purchase"), stage("cart")) * 100).alias("cart_to_purchase_pct"),
                     order.alias("_o"))
             .orderBy("_o", "event_type").drop("_o"))
