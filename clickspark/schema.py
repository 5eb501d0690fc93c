"""Fixed schemas (no inference: inference is an extra pass over the data and
monthly files could infer different types)."""

from pyspark.sql import types as T

RAW_EVENT_SCHEMA = T.StructType([
    T.StructField("event_time", T.TimestampType(), True),
    T.StructField("event_type", T.StringType(), True),
    T.StructField("product_id", T.LongType(), True),
    T.StructField("category_id", T.LongType(), True),
    T.StructField("category_code", T.StringType(), True),
    T.StructField("brand", T.StringType(), True),
    T.StructField("price", T.DoubleType(), True),
    T.StructField("user_id", T.LongType(), True),
    T.StructField("user_session", T.StringType(), True),
])

RAW_COLUMNS = [f.name for f in RAW_EVENT_SCHEMA.fields]

CORRUPT_COL = "_corrupt_record"

RAW_EVENT_SCHEMA_WITH_CORRUPT = T.StructType(
    RAW_EVENT_SCHEMA.fields + [T.StructField(CORRUPT_COL, T.StringType(), True)])

CLEAN_COLUMNS = RAW_COLUMNS + [
    "brand_was_missing", "category_was_missing", "hour", "day_of_week",
    "is_weekend", "date",
]

# Funnel stages in their fixed order (view -> cart -> purchase).

# Feature columns of the purchase / abandonment models, in model order.
FEATURE_COLS = [
    "total_events", "views", "carts", "unique_products",
    "active_span_sec", "events_per_day",
    "cart_to_view_ratio", "product_diversity",
    "has_past_purchase", "purchase_rate",
]

#: Event times in raw CSV files, for batch and stream alike: fractions, zone
#: names and offsets are optional.
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss[.SSSSSS][ z][XXX]"
