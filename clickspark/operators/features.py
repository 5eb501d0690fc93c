"""Leakage-free features and labels, N66-N72.

The cutoff is the interpolated 0.8 quantile of event time, computed
exactly and distributed (``ranking.quantiles`` on whole microseconds).  It is
then a literal, so ``event_time <= cutoff`` is pushed into the Parquet scan.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickspark.functions.numeric import micros
from clickspark.operators.ranking import quantiles

_is = lambda t: F.col("event_type") == t


def time_cutoff(ev: DataFrame, q: float = 0.8, accuracy: int | None = None) -> DataFrame:
    """One-row frame with ``cutoff_time``, the interpolated quantile of
    event_time (SQL ``quantile_cont``, rounded to the microsecond).
    ``accuracy`` switches to a one-pass approximate quantile."""
    us = ev.select(micros("event_time").alias("_us"))
    # a column scan of the event table: the passes re-read one column,
    # cheaper than writing it out
    qq = quantiles(us, "_us", [q], ["_q"], method="sql", materialize=False, accuracy=accuracy)
    return qq.select(F.timestamp_micros(F.round("_q").cast("long")).alias("cutoff_time"))


def cutoff_value(ev: DataFrame, q: float = 0.8, accuracy: int | None = None) -> dt.datetime:
    """The cutoff as a driver-side scalar (one value)."""
    return time_cutoff(ev, q, accuracy).first()["cutoff_time"]


def time_filter(ev: DataFrame, cutoff, past: bool) -> DataFrame:
    """``event_time <= cutoff`` (or ``>``), plus a predicate on the ``date``
    partition column when present, so whole date folders are skipped (a
    predicate on event_time alone does not prune partitions).  The dates may
    have been taken in another zone than the session's, so they are bounded
    a day further out; ``event_time`` decides."""
    t = F.col("event_time")
    cond = (t <= F.lit(cutoff)) if past else (t > F.lit(cutoff))
    if "date" in ev.columns:
        d = F.to_date(F.lit(cutoff))
        cond = cond & ((F.col("date") <= F.date_add(d, 1)) if past else (F.col("date") >= F.date_sub(d, 1)))
    return ev.where(cond)


def past_features(ev: DataFrame, cutoff) -> DataFrame:
    """Per user with events at or before the cutoff: events, views,
    carts, past purchases, distinct products and active span (seconds)."""
    g = (time_filter(ev, cutoff, past=True)
           .groupBy("user_id").agg(
               F.count("*").alias("total_events"),
               F.count(F.when(_is("view"), 1)).alias("views"),
               F.count(F.when(_is("cart"), 1)).alias("carts"),
               F.count(F.when(_is("purchase"), 1)).alias("past_purchases"),
               F.countDistinct("product_id").alias("unique_products"),
               F.min("event_time").alias("_a"), F.max("event_time").alias("_b")))
    return g.select("user_id", "total_events", "views", "carts", "past_purchases", "unique_products",
                    ((micros("_b") - micros("_a")).cast("double") / F.lit(1e6)).alias("active_span_sec"))


def future_labels(ev: DataFrame, cutoff) -> DataFrame:
    """Label 1 if the user purchases after the cutoff (users with any
    event after it)."""
    return (time_filter(ev, cutoff, past=False)
              .groupBy("user_id")
              .agg(F.when(F.count(F.when(_is("purchase"), 1)) > 0, 1).otherwise(0).alias("label")))


def ml_dataset(ev: DataFrame, cutoff=None, q: float = 0.8) -> DataFrame:
    """Past features ⟕ future labels (0 when absent) with derived
    features; infinities / NaN become 0.  The join is on user_id, both
    sides aggregated by user_id (co-partitioned: one shuffle each)."""
    if cutoff is None:
        cutoff = cutoff_value(ev, q)
    f = past_features(ev, cutoff)
    lab = future_labels(ev, cutoff)
    lab = lab.withColumnRenamed("user_id", "_u")
    # null-safe: events without a user are one user on both sides
    d = (f.join(lab, f.user_id.eqNullSafe(lab["_u"]), "left").drop("_u")
         .withColumn("label", F.coalesce("label", F.lit(0))))
    span = F.col("active_span_sec")
    out = d.select(
        "user_id", "total_events", "views", "carts", "past_purchases", "unique_products", "label",
        span.alias("active_span_sec"),
        (F.col("total_events") / (span / F.lit(86400.0) + F.lit(1.0))).alias("events_per_day"),
        (F.col("carts") / (F.col("views") + F.lit(1.0))).alias("cart_to_view_ratio"),
        (F.col("unique_products") / (F.col("views") + F.lit(1.0))).alias("product_diversity"),
        (F.col("past_purchases") > 0).cast("int").alias("has_past_purchase"),
        (F.col("past_purchases") / (F.col("total_events") + F.lit(1.0))).alias("purchase_rate"))
    dbl = ["active_span_sec", "events_per_day", "cart_to_view_ratio", "product_diversity", "purchase_rate"]
    return out.select(*[F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), F.lit(0.0))
                         .otherwise(F.col(c)).alias(c) if c in dbl else F.col(c) for c in out.columns])


def label_balance(ds: DataFrame, label: str = "label") -> DataFrame:
    """Rows per label value."""
    return ds.groupBy(label).agg(F.count("*").alias("count")).orderBy(label)


def feature_summary(ds: DataFrame, cols: Sequence[str] | None = None, decimals: int = 3) -> DataFrame:
    """Pandas ``describe().round(3)``: count / mean / std (sample) /
    min / quartiles / max of every numeric column, one row per statistic.
    The moments are one aggregate row; quartiles are exact (numpy rule) per
    column (one set of passes for all columns); the table is 8 rows by
    the number of columns."""
    import numpy as np
    from clickspark.operators.ranking import stage_table, column_quantiles
    cols = list(cols or [c for c, t in ds.dtypes if t in ("int", "bigint", "double")])
    ds = stage_table(ds.select(*cols))  # several passes read it
    stats = ds.agg(*[F.count(c).cast("double").alias(f"count__{c}") for c in cols],
                   *[F.avg(c).alias(f"mean__{c}") for c in cols],
                   *[F.stddev_samp(c).alias(f"std__{c}") for c in cols],
                   *[F.min(c).cast("double").alias(f"min__{c}") for c in cols],
                   *[F.max(c).cast("double").alias(f"max__{c}") for c in cols]).first()
    rows = {s_: [stats[f"{s_}__{c}"] for c in cols] for s_ in ("count", "mean", "std", "min", "max")}
    qv = column_quantiles(ds, cols, [0.25, 0.5, 0.75])
    for k, nm in enumerate(("25%", "50%", "75%")):
        rows[nm] = [qv[c][k] for c in cols]
    order = ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]
    rnd = lambda v: None if v is None else float(np.round(float(v), decimals))
    return ds.sparkSession.createDataFrame([(s_, *[rnd(v) for v in rows[s_]]) for s_ in order],
                                           ["statistic", *cols])


def _class_ranks(ds: DataFrame, label: str, seed: int, key: str) -> DataFrame:
    """``ds`` with ``_pos``, the 0-based place among the rows of its label by
    the MD5 of ``seed:key`` (any SQL engine has it, so the rows can be told
    outside Spark), and ``_of``, the label's rows: one global ranking by
    (label, digest, key), less each label's start (one row per label)."""
    from clickspark.operators.ranking import global_rank
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = ds.withColumn("_h", F.md5(name))
    r = global_rank(h, [F.col(label), F.col("_h"), F.col(key)], rank_col="_rn", count_col="_n")
    start = r.groupBy(F.col(label).alias("_l")).agg(F.min("_rn").alias("_first"), F.count(F.lit(1)).alias("_of"))
    return (r.join(F.broadcast(start), r[label].eqNullSafe(start["_l"]))
             .withColumn("_pos", F.col("_rn") - F.col("_first")).drop("_h", "_rn", "_n", "_l", "_first"))


def stratified_split(ds: DataFrame, label: str = "label", test_size: float = 0.2, seed: int = 42,
                     key: str = "user_id") -> DataFrame:
    """Exact stratified train/test split: within each label, rows are
    ordered by a seeded digest of the key and the first ``ceil(test_size *
    n_label)`` go to test.  Reproducible at any partitioning; no class is
    funnelled into one task."""
    r = _class_ranks(ds, label, seed, key)
    return r.withColumn("is_test", (F.col("_pos") < F.ceil(F.col("_of") * F.lit(test_size))).cast("int")) \
            .drop("_pos", "_of")


def stratified_folds(ds: DataFrame, label: str = "label", k: int = 3, seed: int = 42,
                     key: str = "user_id") -> DataFrame:
    """Fold number 0..k-1 per row, stratified: within each label rows
    are ordered by a seeded digest and dealt round-robin."""
    r = _class_ranks(ds, label, seed + 1, key)
    return r.withColumn("fold", (F.col("_pos") % k).cast("int")).drop("_pos", "_of")
