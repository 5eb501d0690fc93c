"""Sequences and time to purchase, N44-N51.

Transitions (N45) need each event's successor in the user's time order.  A
``lead`` over ``Window.partitionBy(user_id)`` would put a very active user
(a bot can hold a large share of all events) into one task.  Instead the
events are range-partitioned on (user, time, tie-break) - so one user's
timeline can span several partitions - sorted within partitions, and each
partition counts its own adjacent pairs in Arrow batches, emitting only
pair counts plus its first and last event.  The pairs that straddle two
partitions are recovered from those boundary rows (two rows per partition).
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickspark.functions.numeric import micros, round_sql, seconds_between
from clickspark.operators.ranking import stage_table, quantiles

# Event order within a user: time, then a fixed tie-break so the sequence
# does not depend on file order or partition count.
TIE_BREAK = ("event_type", "product_id", "price")

_PARTS_SCHEMA = ("kind int, pid int, from_event string, to_event string, cnt long, "
                 "f_key string, f_type string, l_key string, l_type string")


def dataset_totals(ev: DataFrame) -> DataFrame:
    """Number of events and of distinct users."""
    return ev.agg(F.count("*").alias("total_events"),
                  F.countDistinct("user_id").alias("unique_users"))


def _pairs_fn(keys: Sequence[str]):
    """Per-partition pass over rows sorted by (keys, time, tie-break): count
    adjacent pairs whose keys are all equal; also emit the partition's first
    and last (key, event_type)."""
    keys = list(keys)

    def key_str(pdf, i):
        return "\x1f".join(repr(pdf[k].iloc[i]) for k in keys)

    def run(it):
        counts: dict[tuple[str, str], int] = {}
        first = last = None
        last_vals = None
        pid = None
        for pdf in it:
            if pdf.empty:
                continue
            if pid is None:
                pid = int(pdf["_pid"].iloc[0])
                first = (key_str(pdf, 0), pdf["event_type"].iloc[0])
            t = pdf["event_type"].to_numpy(dtype=object)
            cols = [pdf[k].to_numpy() for k in keys]
            if last_vals is not None and all(lv == c[0] for lv, c in zip(last_vals, cols)):
                key = (last[1], t[0])
                counts[key] = counts.get(key, 0) + 1
            same = None
            for c in cols:
                e = c[1:] == c[:-1]
                same = e if same is None else (same & e)
            if same is not None and same.any():
                # events without a type count like any other
                vc = pd.DataFrame({"f": t[:-1][same], "t": t[1:][same]}).value_counts(dropna=False)
                for pair, n in vc.items():
                    pair = tuple(None if pd.isna(x) else x for x in pair)
                    counts[pair] = counts.get(pair, 0) + int(n)
            last_vals = [c[-1] for c in cols]
            last = (key_str(pdf, len(pdf) - 1), t[-1])
        if pid is None:
            return
        rows = [(0, pid, a, b, n, None, None, None, None) for (a, b), n in counts.items()]
        rows.append((1, pid, None, None, 0, first[0], first[1], last[0], last[1]))
        yield pd.DataFrame(rows, columns=["kind", "pid", "from_event", "to_event", "cnt",
                                          "f_key", "f_type", "l_key", "l_type"])
    return run


def transition_counts(ev: DataFrame, by: Sequence[str] = ("user_id",),
                      num_partitions: int | None = None) -> DataFrame:
    """First-order transition counts (from_event, to_event, count) along each
    user's event sequence (crossing day edges, as the reference).  ``by``
    other than user_id (e.g. ``("user_id", "session_date")``) restarts the
    sequence per group.  Events of a null user have no sequence."""
    by = list(by)
    base = ev.where(F.col("user_id").isNotNull())
    if "session_date" in by and "session_date" not in ev.columns:
        base = base.withColumn("session_date", F.to_date("event_time"))
    order = [F.col(c) for c in by] + [F.col("event_time")] + [F.col(c) for c in TIE_BREAK]
    ranged = (base.repartitionByRange(int(num_partitions), *order) if num_partitions
              else base.repartitionByRange(*order))  # AQE may merge adjacent small ranges
    sorted_ev = (ranged.sortWithinPartitions(*order)
                     .select(*by, "event_type", F.spark_partition_id().alias("_pid")))
    # the pass emits a few rows per partition; materialise them once so the
    # range shuffle, sort and pass run once for both uses below
    parts = stage_table(sorted_ev.mapInPandas(_pairs_fn(by), _PARTS_SCHEMA))
    inner = parts.where(F.col("kind") == 0).select("from_event", "to_event", "cnt")
    # boundary rows: one per non-empty partition, so this window is bounded
    # by the partition count
    b = parts.where(F.col("kind") == 1).select("pid", "f_key", "f_type", "l_key", "l_type")
    w = Window.orderBy("pid")
    edge = (b.select("l_key", "l_type",
                     F.lead("f_key").over(w).alias("n_key"),
                     F.lead("f_type").over(w).alias("n_type"))
             .where(F.col("l_key") == F.col("n_key"))
             .select(F.col("l_type").alias("from_event"), F.col("n_type").alias("to_event"),
                     F.lit(1).cast("long").alias("cnt")))
    return (inner.unionByName(edge).groupBy("from_event", "to_event")
                 .agg(F.sum("cnt").cast("long").alias("count")))


def transition_probs(ev: DataFrame, by: Sequence[str] = ("user_id",),
                     num_partitions: int | None = None) -> DataFrame:
    """Transition counts and P(to | from) rounded to 4 places, ordered
    by from_event, prob desc."""
    c = transition_counts(ev, by, num_partitions)
    tot = F.sum("count").over(Window.partitionBy("from_event"))
    return (c.select("from_event", "to_event", "count",
                     round_sql(F.col("count") * F.lit(1.0) / tot, 4).alias("prob"))
             .orderBy("from_event", F.desc("prob"), "to_event"))


def transition_matrix(tp: DataFrame, states: Sequence[str] | None = None) -> DataFrame:
    """From x to pivot of probabilities, missing cells 0."""
    p = tp.groupBy("from_event").pivot("to_event", list(states) if states else None).agg(F.max("prob"))
    vals = [c for c in p.columns if c != "from_event"]
    return p.fillna(0.0, subset=vals).orderBy("from_event")


def top_transitions(tp: DataFrame, k: int = 10) -> DataFrame:
    """K most probable transitions (ties by from, to)."""
    return tp.orderBy(F.desc("prob"), "from_event", "to_event").limit(k)


def time_to_purchase(ev: DataFrame) -> DataFrame:
    """Per user first view, first purchase, converted flag and the
    seconds between (null if either is missing; negative when the purchase
    precedes the first view)."""
    g = ev.groupBy("user_id").agg(
        F.min(F.when(F.col("event_type") == "view", F.col("event_time"))).alias("first_view"),
        F.min(F.when(F.col("event_type") == "purchase", F.col("event_time"))).alias("purchase_time"),
        F.count(F.when(F.col("event_type") == "purchase", 1)).alias("_np"))
    return g.select("user_id", "first_view", "purchase_time",
                    F.when(F.col("_np") > 0, 1).otherwise(0).alias("converted"),
                    seconds_between("first_view", "purchase_time").alias("time_to_purchase_sec"))


def time_to_purchase_clean(ttp: DataFrame) -> DataFrame:
    """Converted users with a non-negative time."""
    return ttp.where((F.col("converted") == 1) & (F.col("time_to_purchase_sec") >= 0))


def time_to_purchase_stats(clean: DataFrame) -> DataFrame:
    """N50: count, mean, median, P25, P75, P95 in hours (quantiles exact,
    numpy linear interpolation; the mean from exact microsecond sums).  The
    per-user times are materialised once and read by every pass."""
    h = stage_table(clean.select((F.col("time_to_purchase_sec") / F.lit(3600.0)).alias("h"),
                             (micros("purchase_time") - micros("first_view")).alias("_us")))
    q = quantiles(h, "h", [0.5, 0.25, 0.75, 0.95], ["median_hours", "p25_hours", "p75_hours", "p95_hours"],
                  materialize=False)
    m = h.agg(F.count("*").alias("count"),
              (F.sum("_us").cast("double") / F.count("*") / F.lit(3.6e9)).alias("mean_hours"))
    mrow = m.first()
    return q.select(F.lit(mrow["count"]).cast("long").alias("count"),
                    F.lit(mrow["mean_hours"]).cast("double").alias("mean_hours"),
                    "median_hours", "p25_hours", "p75_hours", "p95_hours")


# Fixed bucket edges (hours, right-closed, 0 excluded) and labels.
TTP_EDGES = (0, 1, 4, 12, 24, 72)
TTP_LABELS = ("<1h", "1-4h", "4-12h", "12-24h", "1-3d", "3d+")


def time_to_purchase_buckets(clean: DataFrame) -> DataFrame:
    """Right-closed hour buckets (``pd.cut``; exactly 0 h is in no
    bucket), all six listed in order with their counts."""
    h = F.col("time_to_purchase_sec") / F.lit(3600.0)
    b = F.lit(None).cast("int")
    for i in range(len(TTP_EDGES) - 1, -1, -1):
        hi = TTP_EDGES[i + 1] if i + 1 < len(TTP_EDGES) else None
        cond = (h > TTP_EDGES[i]) if hi is None else ((h > TTP_EDGES[i]) & (h <= hi))
        b = F.when(cond, F.lit(i + 1)).otherwise(b)
    cnt = clean.groupBy(b.alias("bucket_order")).agg(F.count("*").alias("count")).where(
        F.col("bucket_order").isNotNull())
    spark = clean.sparkSession
    spine = spark.createDataFrame([(i + 1, lab) for i, lab in enumerate(TTP_LABELS)],
                                  "bucket_order int, bucket string")
    return (spine.join(cnt, "bucket_order", "left")
                 .select("bucket", F.coalesce("count", F.lit(0)).cast("long").alias("count"), "bucket_order")
                 .orderBy("bucket_order").drop("bucket_order"))
