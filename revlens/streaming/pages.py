"""Incremental ingestion of landed review pages with Structured Streaming.

The reference fetches review pages on demand; at scale pages keep landing as
files. ``page_stream`` reads them incrementally (file source, explicit schema),
``running_revenue_at_risk`` keeps the additive product metrics (review count,
negative count, revenue at risk) as streaming state keyed by product, and
``land_pages`` appends repaired reviews to a table with exactly-once progress
tracked in a checkpoint under the shared checkpoint folder.

Scored metrics that need global min/max (CIS, impact, PPS) are not additive;
they stay batch operators over the landed table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.functions import columns as C
from revlens.functions import constants as K
from revlens.session import drop_other_folders

REVIEW_FIELDS = T.StructType([
    T.StructField("product", T.StringType()),
    T.StructField("rating", T.DoubleType()),
    T.StructField("review_text", T.StringType()),
    T.StructField("sentiment", T.StringType()),
    T.StructField("customer_ltv", T.DoubleType()),
    T.StructField("order_value", T.DoubleType()),
    T.StructField("days_since_purchase", T.DoubleType()),
    T.StructField("helpful_votes", T.DoubleType()),
    T.StructField("is_repeat_customer", T.BooleanType()),
    T.StructField("verified_purchase", T.BooleanType()),
    T.StructField("review_date", T.StringType()),
])
PAGE_SCHEMA = T.StructType([
    T.StructField("data", T.ArrayType(REVIEW_FIELDS)),
    T.StructField("metadata", T.StructType([T.StructField("page", T.IntegerType())])),
])


def page_stream(spark: SparkSession, path: str, schema: T.StructType = PAGE_SCHEMA,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming reviews from landed page envelopes (one envelope per line)."""
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    env = r.json(path)
    rows = env.select(F.col("metadata.page").alias("page"),
                      F.posexplode(F.col("data")).alias("page_pos", "r"))
    rev = rows.select("page", "page_pos", "r.*")
    product = C.strip_ws(F.coalesce(F.col("product"), F.lit("General")))
    return rev.withColumns({
        "product": product,
        "customer_ltv": F.coalesce(C.to_double("customer_ltv"), F.lit(0.0)),
    }).filter(F.col("product") != "")


def running_revenue_at_risk(reviews: DataFrame, risky_max: float = K.RISKY_MAX_RATING
                            ) -> DataFrame:
    """Per-product running totals (state size = number of products)."""
    risky = F.col("rating") <= risky_max
    return reviews.groupBy("product").agg(
        F.count(F.lit(1)).alias("total_reviews"),
        F.count_if(risky).alias("negative_count"),
        F.coalesce(C.money_sum(F.when(risky, F.col("customer_ltv"))), F.lit(0.0))
        .alias("total_revenue_at_risk"))


EPOCH = "epoch"


def run_available(query_df: DataFrame, sink_path: str, checkpoint: str,
                  output_mode: str = "complete") -> None:
    """Process everything landed so far (``availableNow``) into a parquet table with a folder for
    each micro-batch. A batch that is run again after a failure writes its own folder again, so
    it is there once. In complete mode the folders of earlier batches go after the new one is
    written, so a reader never finds the table empty; ``read_sink`` reads the table."""
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink_path}/{EPOCH}={epoch}")
        if output_mode == "complete":
            drop_other_folders(batch.sparkSession, sink_path, f"{EPOCH}={epoch}")

    q = (query_df.writeStream.outputMode(output_mode).foreachBatch(write)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def read_sink(spark: SparkSession, sink_path: str, output_mode: str = "complete") -> DataFrame:
    """The table that ``run_available`` keeps: the last finished batch's rows in complete mode,
    the rows of all batches in append mode."""
    table = spark.read.parquet(sink_path)
    if output_mode == "complete":
        last = table.agg(F.max(EPOCH)).first()[0]
        table = table.where(F.col(EPOCH) == last)
    return table.drop(EPOCH)


def land_pages(spark: SparkSession, pages_path: str, table_path: str, checkpoint: str) -> None:
    """Append every newly landed page's reviews to ``table_path`` (exactly once)."""
    q = (page_stream(spark, pages_path).writeStream.format("parquet")
         .option("path", table_path).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
