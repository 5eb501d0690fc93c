"""N7 ``clean_events``: the raw-to-clean step of ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickspark.functions.numeric import flag

# Fixed values of the cleaning rule: valid prices are 0 < price < 100000,
# missing brand / category become 'Unknown'.
PRICE_LOW = 0
PRICE_HIGH = 100000
UNKNOWN = "Unknown"


def clean_events(raw: DataFrame) -> DataFrame:
    """Price range filter (pushed to the scan), 'Unknown' fill with
    was-missing flags, and derived hour / day_of_week (0 = Sunday) /
    is_weekend / date columns.  Narrow: no shuffle."""
    ts = F.col("event_time")
    dow = F.dayofweek(ts) - 1  # Spark: 1 = Sunday
    return (raw
            .where((F.col("price") > PRICE_LOW) & (F.col("price") < PRICE_HIGH))
            .select(
                "event_time", "event_type", "product_id", "category_id",
                F.coalesce("category_code", F.lit(UNKNOWN)).alias("category_code"),
                F.coalesce("brand", F.lit(UNKNOWN)).alias("brand"),
                "price", "user_id", "user_session",
                flag(F.col("brand").isNull()).alias("brand_was_missing"),
                flag(F.col("category_code").isNull()).alias("category_was_missing"),
                F.hour(ts).cast("int").alias("hour"),
                dow.cast("int").alias("day_of_week"),
                flag(dow.isin(0, 6)).alias("is_weekend"),
                F.to_date(ts).alias("date"),
            ))
