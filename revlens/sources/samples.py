"""The reference's built-in five-row dataset (used when no source is given)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---- fixed values: built-in sample rows ---------------------------------------
SAMPLE_ROWS = [
    ("Atlas Desk", 2.8, 10000, 5000, "Quality issues", 5, 15, True, True),
    ("Pulse Earbuds", 3.1, 8000, 3000, "Sound great", 3, 20, False, True),
    ("North Mug", 3.6, 5000, 1000, "Perfect", 1, 30, True, True),
    ("Harbor Lamp", 3.4, 7000, 4000, "Broken", 8, 10, False, True),
    ("Summit Bottle", 3.9, 6000, 2000, "Excellent", 2, 45, True, True),
]
SAMPLE_SCHEMA = T.StructType([
    T.StructField("product", T.StringType()), T.StructField("rating", T.DoubleType()),
    T.StructField("customer_ltv", T.LongType()), T.StructField("order_value", T.LongType()),
    T.StructField("review_text", T.StringType()), T.StructField("helpful_votes", T.LongType()),
    T.StructField("days_since_purchase", T.LongType()),
    T.StructField("is_repeat_customer", T.BooleanType()),
    T.StructField("verified_purchase", T.BooleanType()),
    T.StructField("review_date", T.StringType()),
])


def sample_reviews(spark: SparkSession, now_iso: str | None = None) -> DataFrame:
    """Five fixed reviews; every review_date is 'now' in ISO form (or ``now_iso``)."""
    stamp = now_iso or datetime.now().isoformat()
    return spark.createDataFrame([r + (stamp,) for r in SAMPLE_ROWS], SAMPLE_SCHEMA)
