"""The driver's parquet tables and the review view derived from them.

The tables carry no reviews, so reviews are derived by integer arithmetic on
keys (one review per lineitem). Join order is chosen for scale: orders is
joined to customer (an orders-sized shuffle), and the lineitem-sized stream is
shuffled only twice (on part key, then order key, so that the lines of an order
end side by side). All three joins are pinned to sort-merge joins: their sides
grow with the input, and the planner judges a file by its compressed size, so it
would send a million parts through the driver as "small". Skewed keys are split
by AQE's skew-join handling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None
               ) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey",
                                                "l_quantity", "l_returnflag", "l_shipdate"])
    od = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_totalprice"])
    cu = read_table(spark, sf_dir, "customer", ["c_custkey", "c_acctbal"])
    pa = read_table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_brand"])
    oc = od.join(cu.hint("merge"), od.o_custkey == cu.c_custkey).select(
        F.col("o_orderkey"), F.col("o_custkey").alias("ck"), F.col("o_totalprice").alias("tp"),
        F.col("c_acctbal").alias("ab"))
    # Always sort-merge joins. Without the hints Spark builds all customers and parts in the
    # driver while their files look small, and adaptive execution may broadcast the
    # (post-shuffle) line item side and stream the orders file in a single task.
    lp = li.join(pa.hint("merge"), li.l_partkey == pa.p_partkey)
    return lp.hint("merge").join(oc, lp.l_orderkey == oc.o_orderkey).select(
        F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"),
        F.col("l_partkey").alias("pk"), F.col("l_quantity").alias("q"),
        F.col("l_returnflag").alias("rf"), F.col("l_shipdate").alias("sd"), "ck", "tp", "ab",
        F.col("p_brand").alias("br"), F.col("p_name").alias("pn"))


# ---- fixed values: the derived review texts (one in eight is null) --------
REVIEW_TEXTS = [
    "Late delivery, box torn",
    "Poor quality, broken lid",
    "Support never replied to my refund request",
    "Too expensive for what it is",
    "Perfect for coffee",
    "Love the chocolate plate",
    "Fine",
    None,
]


def _text_expr(k):
    out = None
    for i, t in enumerate(REVIEW_TEXTS):
        v = F.lit(t).cast("string")
        out = F.when(k == i, v) if out is None else out.when(k == i, v)
    return out


def _review_columns():
    ok, ln, pk = F.col("ok"), F.col("ln"), F.col("pk")
    rating_raw = (F.lit(1.0) + ((ok * 7 + ln * 3 + pk) % 9).cast("double") * 0.5
                  + F.when(pk % 4 == 0, -1.0).when(pk % 4 == 1, 0.5).otherwise(0.0))
    rating = F.greatest(F.lit(1.0), F.least(F.lit(5.0), rating_raw)).cast("double")
    s = (ok + pk) % 5
    sentiment = (F.when(s == 0, "positive").when(s < 3, "negative").when(s == 3, "neutral")
                 .otherwise("mixed"))
    return {
        "product": F.concat(F.col("pn"), F.lit(" "), F.col("br")),
        "rating": rating,
        "review_text": _text_expr((ok + ln + pk) % 8),
        "sentiment": sentiment,
        "customer_ltv": F.when(F.col("ab") > 0, F.col("ab")).otherwise(F.lit(0.0)),
        "order_value": F.col("tp"),
        "days_since_purchase": ((ok * 13 + ln * 5) % 120).cast("double"),
        "helpful_votes": F.col("q"),
        "is_repeat_customer": F.col("ck") % 3 != 0,
        "verified_purchase": F.col("rf") != "N",
        "review_date": F.col("sd"),
    }


def review_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical-schema reviews, one per lineitem."""
    cols = _review_columns()
    return _base(spark, sf_dir).select(*[c.alias(n) for n, c in cols.items()])


def raw_review_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews as a messy source would send them: aliased names, rating as text with
    spoiled ('bad') and missing values, blank and missing product names, raw
    (possibly negative) account balance as LTV."""
    cols = _review_columns()
    ok, pk = F.col("ok"), F.col("pk")
    spoil = (ok + pk) % 11 == 0
    rating_txt = (F.when(spoil & ((ok % 2) == 0), F.lit("bad"))
                  .when(spoil, F.lit(None).cast("string"))
                  .otherwise(cols["rating"].cast("string")))
    product = (F.when((ok + pk) % 13 == 0, F.lit("  "))
               .when((ok + pk) % 17 == 0, F.lit(None).cast("string"))
               .otherwise(cols["product"]))
    return _base(spark, sf_dir).select(
        product.alias("product_name"), rating_txt.alias("rating"),
        cols["review_text"].alias("review_text"), cols["sentiment"].alias("sentiment"),
        F.col("ab").alias("ltv"), cols["order_value"].alias("order_value"),
        cols["days_since_purchase"].alias("days_since_purchase"),
        cols["helpful_votes"].alias("helpful_votes"),
        cols["is_repeat_customer"].alias("is_repeat_customer"),
        cols["verified_purchase"].alias("verified_purchase"),
        cols["review_date"].alias("review_date"))


# ---- the same views as DuckDB SQL (used by the oracle) ---------------------
BASE_SQL = """select l.l_orderkey ok, l.l_linenumber ln, l.l_partkey pk, l.l_quantity q,
  l.l_returnflag rf, l.l_shipdate sd, o.o_custkey ck, o.o_totalprice tp, c.c_acctbal ab,
  p.p_brand br, p.p_name pn
 from lineitem l join orders o on l.l_orderkey = o.o_orderkey
 join customer c on o.o_custkey = c.c_custkey join part p on l.l_partkey = p.p_partkey"""

RATING_SQL = ("cast(greatest(1.0, least(5.0, 1.0 + ((ok*7 + ln*3 + pk) % 9) * 0.5 "
              "+ case when pk % 4 = 0 then -1.0 when pk % 4 = 1 then 0.5 else 0.0 end)) "
              "as double)")
PRODUCT_SQL = "concat(pn, ' ', br)"


def _text_sql() -> str:
    parts = []
    for i, t in enumerate(REVIEW_TEXTS):
        if t is not None:
            parts.append(f"when {i} then '{t}'")
    return f"case (ok + ln + pk) % 8 {' '.join(parts)} else null end"


REVIEWS_SQL = f"""select {PRODUCT_SQL} as product,
 {RATING_SQL} as rating,
 {_text_sql()} as review_text,
 case when (ok + pk) % 5 = 0 then 'positive' when (ok + pk) % 5 < 3 then 'negative'
   when (ok + pk) % 5 = 3 then 'neutral' else 'mixed' end as sentiment,
 case when ab > 0 then ab else cast(0 as double) end as customer_ltv, tp as order_value,
 cast((ok*13 + ln*5) % 120 as double) as days_since_purchase, q as helpful_votes,
 ck % 3 <> 0 as is_repeat_customer, rf <> 'N' as verified_purchase, sd as review_date
from ({BASE_SQL}) base"""

RAW_REVIEWS_SQL = f"""select
 case when (ok + pk) % 13 = 0 then '  ' when (ok + pk) % 17 = 0 then null
      else {PRODUCT_SQL} end as product_name,
 case when (ok + pk) % 11 = 0 and ok % 2 = 0 then 'bad' when (ok + pk) % 11 = 0 then null
      else cast({RATING_SQL} as varchar) end as rating,
 {_text_sql()} as review_text,
 case when (ok + pk) % 5 = 0 then 'positive' when (ok + pk) % 5 < 3 then 'negative'
   when (ok + pk) % 5 = 3 then 'neutral' else 'mixed' end as sentiment,
 ab as ltv, tp as order_value,
 cast((ok*13 + ln*5) % 120 as double) as days_since_purchase, q as helpful_votes,
 ck % 3 <> 0 as is_repeat_customer, rf <> 'N' as verified_purchase, sd as review_date
from ({BASE_SQL}) base"""


# ---- dates for spike detection ------------------------------------------------------------
SPIKE_DAY = "2024-06-30"


def spike_review_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews whose date is a fixed day minus ``ok % 10`` days for every tenth
    part and ``ok % 200`` days for the rest, so some products spike."""
    cols = _review_columns()
    back = F.when(F.col("pk") % 10 == 0, F.col("ok") % 10).otherwise(F.col("ok") % 200)
    cols["review_date"] = F.date_sub(F.lit(SPIKE_DAY).cast("date"), back.cast("int")) \
        .cast("timestamp_ntz")
    return _base(spark, sf_dir).select(*[c.alias(n) for n, c in cols.items()])


SPIKE_REVIEWS_SQL = REVIEWS_SQL.replace(
    "sd as review_date",
    f"cast(date '{SPIKE_DAY}' - cast(case when pk % 10 = 0 then ok % 10 else ok % 200 end "
    "as integer) as timestamp) as review_date")
