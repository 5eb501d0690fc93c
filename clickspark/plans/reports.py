"""JSON report documents N40 / N65 (S11): one-row frames whose columns are
structs / arrays of structs of already aggregated tables (each a few rows),
assembled without joins: every section is a one-row aggregate, the
sections are stacked with ``unionByName(allowMissingColumns=True)`` and
folded with ``first(ignorenulls=True)``."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickspark.operators import sessions as ss
from clickspark.operators import users as us
from clickspark.operators.ranking import stage_table


def _section_list(name: str, df: DataFrame) -> DataFrame:
    """Rows of a (small) result as an array in the result's order: by its
    ``_order`` key when it has one (unsorted results), else by an
    increasing id taken after the sort (``collect_list`` does not keep row
    order across partitions)."""
    if "_order" in df.columns:
        cols = [c for c in df.columns if c != "_order"]
        arr = F.array_sort(F.collect_list(F.struct(F.col("_order"), *[F.col(c) for c in cols])))
        return df.agg(F.transform(arr, lambda st: F.struct(*[st[c].alias(c) for c in cols])).alias(name))
    cols = df.columns
    o = df.withColumn("_o", F.monotonically_increasing_id())
    arr = F.array_sort(F.collect_list(F.struct(F.col("_o"), *[F.col(c) for c in cols])))
    return o.agg(F.transform(arr, lambda st: F.struct(*[st[c].alias(c) for c in cols])).alias(name))


def _section_row(name: str, df: DataFrame) -> DataFrame:
    return df.select(F.struct(*df.columns).alias(name))


def assemble(header: Mapping[str, object], lists: Mapping[str, DataFrame],
             rows: Mapping[str, DataFrame]) -> DataFrame:
    parts = [_section_row(k, v) for k, v in rows.items()] + [_section_list(k, v) for k, v in lists.items()]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p, allowMissingColumns=True)
    names = list(rows) + list(lists)
    out = u.agg(*[F.first(n, ignorenulls=True).alias(n) for n in names])
    return out.select(F.current_timestamp().alias("generated_at"),
                      *[F.lit(v).alias(k) for k, v in header.items()], *names)


def session_report(ses: DataFrame, data_source: str = "events", staged: bool = False) -> DataFrame:
    """The session analysis master document.  The session table feeds
    eight sections with different column sets (so their exchanges cannot be
    reused): the columns they read are materialised once, unless the caller
    hands over a table that is (``staged``)."""
    if not staged:
        ses = stage_table(ses.select("user_id", "session_start", "session_end", "session_duration_minutes",
                                     "total_events", "unique_products_viewed", "has_purchase", "has_cart",
                                     "session_start_hour", "is_weekend_session"))
    return assemble(
        {"analysis_type": "session_level_behavior_daily_proxy",
         "session_definition": "user and calendar day", "data_source": data_source},
        {"behavior_comparison": ss.session_behavior_comparison(ses, ordered=False),
         "duration_distribution": ss.session_duration_distribution(ses, ordered=False),
         "products_per_session": ss.products_per_session(ses, ordered=False),
         "engagement_levels": ss.session_engagement(ses, ordered=False),
         "cart_abandonment": ss.session_cart_abandonment(ses, ordered=False),
         "hourly_patterns": ss.hourly_session_patterns(ses, ordered=False),
         "weekend_weekday": ss.weekend_weekday_sessions(ses, ordered=False)},
        {"summary": ss.session_summary(ses)})


def rfm_report(usr: DataFrame, data_source: str = "events", staged: bool = False) -> DataFrame:
    """The RFM / behaviour master document, with total, purchasing and
    non-purchasing user counts.  The user table is materialised once (by the
    caller, if ``staged``)."""
    usr = usr if staged else stage_table(usr)
    rfm = us.rfm_values(usr)
    seg = us.rfm_segment(us.rfm_scores(rfm))
    beh = us.behavioral_segment(us.power_users(usr, materialize=False))
    counts = usr.agg(F.count("*").alias("total_users"),
                     F.count(F.when(F.col("total_purchases") > 0, 1)).alias("purchasing_users"),
                     F.count(F.when(F.col("total_purchases") == 0, 1)).alias("non_purchasing_users"))
    return assemble(
        {"analysis_type": "rfm_user_segmentation_synced",
         "session_definition": "user and calendar day", "data_source": data_source},
        {"rfm_segment_distribution": us.rfm_segment_distribution(seg),
         "rfm_segment_characteristics": us.rfm_segment_characteristics(seg),
         "behavioral_segments": us.behavioral_distribution(beh)},
        {"user_counts": counts, "clv_insights": us.clv_insights(rfm)}).select(
            "*", "user_counts.*").drop("user_counts")
