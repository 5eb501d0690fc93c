"""Customer value and segments, N92-N100.

Inputs are the ML dataset plus a probability column (a model's score, or
the data-derived ``engagement_probability`` stand-in).  Min / max for the
0-100 scaling are one aggregate row used as literals; deciles come from
the distributed global rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickspark.functions.numeric import exact_avg, exact_sum, round_np
from clickspark.operators.ranking import qcut_rank

PROB = "purchase_probability"


def engagement_probability(ds: DataFrame, out: str = PROB) -> DataFrame:
    """Deterministic, data-derived stand-in for a model probability:
    ``(past purchases + carts) / (events + 1)``, in [0, 1)."""
    return ds.withColumn(out, (F.col("past_purchases") + F.col("carts")) / (F.col("total_events") + F.lit(1.0)))


def clv_raw(prob: str = PROB) -> Column:
    """``p * log1p(events) * (carts + 1) * (1 + has_past_purchase)``."""
    return (F.col(prob) * F.log1p(F.col("total_events")) * (F.col("carts") + F.lit(1))
            * (F.lit(1) + F.col("has_past_purchase")))


def clv_score(ds: DataFrame, prob: str = PROB, log: bool = True) -> DataFrame:
    """``clv_raw`` and ``clv_score_norm`` = min-max scaling to 0-100
    (2 dp, pandas rounding, 1e-9 guard) of ``log1p(clv_raw)`` (default, the
    reference's final version) or of ``clv_raw`` itself (``log=False``)."""
    d = ds.withColumn("clv_raw", clv_raw(prob))
    base = F.log1p("clv_raw") if log else F.col("clv_raw")
    d = d.withColumn("_clv", base)
    mm = d.agg(F.min("_clv").alias("lo"), F.max("_clv").alias("hi")).first()
    lo, hi = mm["lo"], mm["hi"]
    if lo is None:
        return d.withColumn("clv_score_norm", F.lit(None).cast("double")).drop("_clv")
    norm = (F.col("_clv") - F.lit(lo)) / (F.lit(hi) - F.lit(lo) + F.lit(1e-9)) * F.lit(100.0)
    return d.withColumn("clv_score_norm", round_np(norm, 2)).drop("_clv")


def clv_decile(scored: DataFrame) -> DataFrame:
    """D1..D10 by unique rank of the normalised score (ties by
    user_id)."""
    q = qcut_rank(scored, "clv_score_norm", 10, tie=("user_id",), out="_dec")
    return q.withColumn("clv_decile", F.concat(F.lit("D"), F.col("_dec").cast("string"))) \
            .withColumn("clv_decile_order", F.col("_dec")).drop("_dec")


def clv_decile_summary(dec: DataFrame) -> DataFrame:
    """Mean / min / max / count of the normalised score per decile
    (2 dp), in decile order."""
    s = F.col("clv_score_norm")
    return (dec.groupBy("clv_decile", "clv_decile_order").agg(
                round_np(exact_avg(s), 2).alias("mean"),
                F.min(s).alias("min"), F.max(s).alias("max"), F.count(s).alias("count"))
            .orderBy("clv_decile_order").drop("clv_decile_order"))


def clv_scores(dec: DataFrame) -> DataFrame:
    """User, normalised score, decile."""
    return dec.select("user_id", "clv_score_norm", "clv_decile")


def value_segment_expr(prob: str = PROB) -> Column:
    return (F.when((F.col("has_past_purchase") != 0) & (F.col(prob) >= 0.6), "High-value buyer")
             .when(F.col("has_past_purchase") != 0, "Occasional buyer")
             .when((F.col("carts") > 0) & (F.col("label") == 0), "Cart abandoner")
             .when(F.col("views") > 0, "Browser")
             .otherwise("Dormant"))


def value_segment(scored: DataFrame, prob: str = PROB) -> DataFrame:
    """Value segment, first match wins."""
    return scored.withColumn("segment", value_segment_expr(prob))


def value_segment_summary(seg: DataFrame, prob: str = PROB) -> DataFrame:
    """Users and mean CLV / probability / carts / views per segment
    (3 dp), by mean CLV desc."""
    n = F.count("*")
    g = seg.groupBy("segment").agg(
        n.alias("users"),
        round_np(exact_sum("clv_score_norm") / n, 3).alias("avg_clv"),
        round_np(exact_avg(prob), 3).alias("avg_purchase_p"),
        round_np(F.sum("carts").cast("double") / n, 3).alias("avg_carts"),
        round_np(F.sum("views").cast("double") / n, 3).alias("avg_views"))
    return g.orderBy(F.desc("avg_clv"), "segment")


def value_segment_users(seg: DataFrame, prob: str = PROB) -> DataFrame:
    """Per user segment, probability and normalised CLV."""
    return seg.select("user_id", "segment", prob, "clv_score_norm")


# Fixed thresholds of the reference's targeting rules.
ABANDON_P = 0.6
BROWSER_CART_VIEW = 0.12
BROWSER_PRODUCTS = 3
DORMANT_CLV = 40


def target_audience(seg: DataFrame, segment: str, abandon_prob: str = "abandon_probability") -> DataFrame:
    """N100: the targeting rules as filters: cart abandoners with abandon
    probability > 0.6; browsers with cart/view > 0.12 and > 3 products;
    dormant users with normalised CLV > 40; other segments unfiltered."""
    s = seg.where(F.col("segment") == segment)
    if segment == "Cart abandoner":
        return s.where(F.col(abandon_prob) > ABANDON_P)
    if segment == "Browser":
        return s.where((F.col("cart_to_view_ratio") > BROWSER_CART_VIEW)
                       & (F.col("unique_products") > BROWSER_PRODUCTS))
    if segment == "Dormant":
        return s.where(F.col("clv_score_norm") > DORMANT_CLV)
    return s
