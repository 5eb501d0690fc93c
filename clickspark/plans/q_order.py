"""Order of results (O1, O2, O5, O6) and whole report documents
against SQL.  A result's order is checked by position, taken from the sorted
output; a document is laid out as rows (section, position, field, value)."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickspark.operators import users as us
from clickspark.plans import reports
from clickspark.plans.oracle import with_ev
from clickspark.plans.q_sessions import EVENTS, MINUTES, PRODUCTS, ses
from clickspark.plans.q_users import UT
from clickspark.plans.registry import ORACLE, QUERIES, ev_orders, query


def _labels(column: str, labels) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(labels)) + " END"


# Fixed order of the results of the reference's analyses: key columns, sort keys.
ORDER = {
    "brand_funnel": ("brand", "drop_view_cart NULLS LAST, brand"),
    "brand_analysis": ("brand", "conversion_rate DESC NULLS LAST, brand"),
    "combined_category_funnel": ("category_code", "purchased DESC, category_code"),
    "hourly_funnel": ("hour", "hour"),
    "event_distribution": ("event_type", "n DESC, event_type"),
    "transition_probs": ("from_event, to_event", "from_event, prob DESC, to_event"),
    "top_transitions": ("from_event, to_event", "prob DESC, from_event, to_event"),
    "time_to_purchase_buckets": ("bucket", _labels("bucket", ("<1h", "1-4h", "4-12h", "12-24h", "1-3d", "3d+"))),
    "session_duration_distribution": ("duration_bucket", _labels("duration_bucket", [x[2] for x in MINUTES])),
    "products_per_session": ("products_bucket", _labels("products_bucket", [x[2] for x in PRODUCTS])),
    "session_engagement": ("engagement_level", _labels("engagement_level", [x[2] for x in EVENTS])),
    "hourly_session_patterns": ("hour", "hour"),
    "rfm_segment_distribution": ("Segment", "User_Count DESC, Segment"),
    "rfm_segment_characteristics": ("Segment", "Total_Revenue DESC, Segment"),
    "behavioral_distribution": ("Segment", "User_Count DESC, Segment"),
    "clv_decile_summary": ("clv_decile", "CAST(substr(clv_decile, 2) AS INTEGER)"),
    "value_segment_summary": ("segment", "avg_clv DESC, segment"),
}


def positions(df: DataFrame, keys: list[str]) -> DataFrame:
    """The place of each row in a sorted, small result."""
    seen = df.withColumn("_at", F.monotonically_increasing_id())
    return seen.select(*keys, F.row_number().over(Window.orderBy("_at")).cast("long").alias("position"))


def _register(name: str, keys: str, order: str) -> None:
    @query(f"order_of_{name}", f"SELECT {keys}, ROW_NUMBER() OVER (ORDER BY {order}) AS position FROM ({ORACLE[name]}) o")
    def _run(spark, d):
        return positions(QUERIES[name](spark, d), keys.split(", "))


for _name, (_keys, _order) in ORDER.items():
    _register(_name, _keys, _order)


def flattened(doc: DataFrame, skip: tuple[str, ...] = ("generated_at",)) -> DataFrame:
    """A one-row document as rows: section (its header fields are ``header``),
    position in the section's list (0 for a single struct), field, and the
    value as ``number`` where it reads as one, else as ``text``."""

    def fields(prefix, struct: T.StructType):
        return F.array(*[F.struct(F.lit(f.name).alias("field"), F.col(f"{prefix}.{f.name}").cast("string").alias("value"))
                         for f in struct])

    parts = []
    plain = [f.name for f in doc.schema if f.name not in skip and not isinstance(f.dataType, (T.StructType, T.ArrayType))]
    if plain:
        pairs = F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias("value")) for n in plain])
        parts.append(doc.select(F.lit("header").alias("section"), F.lit(0).alias("position"), F.explode(pairs).alias("x")))
    for f in doc.schema:
        if isinstance(f.dataType, T.StructType):
            parts.append(doc.select(F.lit(f.name).alias("section"), F.lit(0).alias("position"),
                                    F.explode(fields(f.name, f.dataType)).alias("x")))
        elif isinstance(f.dataType, T.ArrayType):
            rows = doc.select(F.posexplode(f.name).alias("_p", "_e"))
            parts.append(rows.select(F.lit(f.name).alias("section"), (F.col("_p") + 1).alias("position"),
                                     F.explode(fields("_e", f.dataType.elementType)).alias("x")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    number = F.col("x.value").try_cast("double")
    return out.select("section", F.col("position").cast("long").alias("position"), F.col("x.field").alias("field"),
                      F.when(number.isNull(), F.col("x.value")).alias("text"), number.alias("number"))


def _section_sql(section: str, sql: str, order: str | None) -> str:
    at = "0" if order is None else f"ROW_NUMBER() OVER (ORDER BY {order})"
    return f"""SELECT '{section}' AS section, CAST(_at AS BIGINT) AS position, field,
  CASE WHEN TRY_CAST(value AS DOUBLE) IS NULL THEN value END AS text, TRY_CAST(value AS DOUBLE) AS number
FROM (SELECT _at, CAST(COLUMNS(* EXCLUDE (_at)) AS VARCHAR) FROM (SELECT *, {at} AS _at FROM ({sql}) s) t) c
  UNPIVOT INCLUDE NULLS (value FOR field IN (COLUMNS(* EXCLUDE (_at)))) u"""


def _document_sql(header: str, sections: dict[str, tuple[str, str | None]]) -> str:
    return "\nUNION ALL\n".join([_section_sql("header", header, None)] + [
        _section_sql(s, ORACLE[q], order) for s, (q, order) in sections.items()])


@query("session_report_document", _document_sql(
    "SELECT 'session_level_behavior_daily_proxy' AS analysis_type, 'user and calendar day' AS session_definition, "
    "'events' AS data_source",
    {"summary": ("session_report_summary", None),
     "behavior_comparison": ("session_behavior_comparison", "session_type"),
     "duration_distribution": ("session_duration_distribution", ORDER["session_duration_distribution"][1]),
     "products_per_session": ("products_per_session", ORDER["products_per_session"][1]),
     "engagement_levels": ("session_engagement", ORDER["session_engagement"][1]),
     "cart_abandonment": ("session_cart_abandonment", "session_count DESC, cart_status"),
     "hourly_patterns": ("hourly_session_patterns", "hour"),
     "weekend_weekday": ("weekend_weekday_sessions", "day_type")}))
def _srd(spark, d):
    return flattened(reports.session_report(ses(spark, d)))


@query("rfm_report_document", _document_sql(
    with_ev("""SELECT 'rfm_user_segmentation_synced' AS analysis_type, 'user and calendar day' AS session_definition,
  'events' AS data_source, COUNT(*) AS total_users, COUNT(*) FILTER (WHERE total_purchases > 0) AS purchasing_users,
  COUNT(*) FILTER (WHERE total_purchases = 0) AS non_purchasing_users FROM ut""", UT),
    {"rfm_segment_distribution": ("rfm_segment_distribution", ORDER["rfm_segment_distribution"][1]),
     "rfm_segment_characteristics": ("rfm_segment_characteristics", ORDER["rfm_segment_characteristics"][1]),
     "behavioral_segments": ("behavioral_distribution", ORDER["behavioral_distribution"][1]),
     "clv_insights": ("clv_insights", None)}))
def _rrd(spark, d):
    return flattened(reports.rfm_report(us.user_table(ev_orders(spark, d))))
