"""Dashboard queries: filters, KPIs, breakdowns, rankings and product records.

Scale notes
* Review-level counts broadcast to rows use aggregate + join, never a window
  partitioned by product (a hot product would land in one task).
* Rankings over the product table are a distributed ``orderBy``; top-N is
  ``orderBy().limit(n)`` (per-partition top-N, then a merge of N rows each).
  Flags such as "top 3" join those N rows back by broadcast (N is a literal).
* Global one-row stats (min/max, sums) are broadcast cross joins.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.functions import columns as C
from revlens.functions import constants as K
from revlens.functions.stats import with_stats
from revlens.operators.products import timestamp_of

# ---- review filters -----------------------------------------------------------


def filter_products(df: DataFrame, products: list[str] | None) -> DataFrame:
    """product IN list; None/empty keeps everything."""
    return df.filter(F.col("product").isin(list(products))) if products else df


def _bound(v, end: bool) -> F.Column:
    """A zone-less timestamp literal: a day widens to 00:00 / 23:59:59.999999."""
    if isinstance(v, datetime):
        text = v.strftime("%Y-%m-%d %H:%M:%S.%f")
    else:
        if not isinstance(v, date):  # a text is read whole: a day or a point in time
            text = str(v).strip()
            if len(text) > 10:
                return _bound(datetime.fromisoformat(text), end)
            v = date.fromisoformat(text)
        text = v.isoformat() + (" 23:59:59.999999" if end else " 00:00:00")
    return F.lit(text).cast("timestamp_ntz")


def filter_dates(df: DataFrame, start, end) -> DataFrame:
    """Coerced review_date between start 00:00 and end 23:59:59.999999 (dates
    given as days are widened to whole days; datetimes are used as given)."""
    d = timestamp_of(df, "review_date")
    return df.filter((d >= _bound(start, False)) & (d <= _bound(end, True)))


def filter_severity(df: DataFrame, threshold: float) -> DataFrame:
    return df.filter(F.col("issue_severity") >= threshold) if threshold > 0 else df


def apply_filters(df: DataFrame, products=None, date_range=None,
                  severity_threshold: float = 0.0) -> DataFrame:
    """Products, date range and severity threshold, applied after scoring
    (the scorer's min-max statistics come from the unfiltered set)."""
    df = filter_products(df, products)
    if date_range and len(date_range) == 2 and "review_date" in df.columns:
        df = filter_dates(df, *date_range)
    if "issue_severity" in df.columns:
        df = filter_severity(df, severity_threshold)
    return df


def filter_risk(products: DataFrame, threshold: float) -> DataFrame:
    return products.filter(F.col("risk_probability") >= threshold) if threshold > 0 else products


def risky_reviews(df: DataFrame) -> DataFrame:
    return df.filter(F.col("rating") <= K.RISKY_MAX_RATING)


def complaint_reviews(df: DataFrame) -> DataFrame:
    return df.filter(F.col("rating") <= K.COMPLAINT_MAX_RATING)


def hidden_risks(products: DataFrame, threshold: float = K.HIDDEN_RISK_MIN) -> DataFrame:
    return products.filter((F.col("risk_probability") > threshold)
                           & (F.col("quadrant") != K.FIRE_FIGHT))


def drop_blank_products(df: DataFrame) -> DataFrame:
    """Drop rows whose product is blank after trimming (missing names are kept,
    as a NaN compares unequal to '')."""
    return df.filter(F.coalesce(C.strip_ws(F.col("product")) != "", F.lit(True)))


def search_products(records: DataFrame, query: str, name_col: str = "name") -> DataFrame:
    return records.filter(F.lower(F.col(name_col)).contains(query.lower()))


def product_lookup(products: DataFrame, name: str) -> DataFrame:
    """Case-insensitive exact name; the first match in score order (then by name)."""
    hit = products.filter(F.lower(F.col("product")) == name.lower())
    order = ([F.col("final_score").desc()] if "final_score" in products.columns else []) + [F.col("product")]
    return hit.orderBy(*order).limit(1)


def filter_records(records: DataFrame, products=None, start: str | None = None,
                   end: str | None = None, severity: str = "All",
                   threshold: float = K.HIDDEN_RISK_MIN) -> DataFrame:
    """Client filter on product records: name IN list, ISO date between (text
    compare), severity equal unless 'All', probability >= threshold."""
    cond = F.lit(True)
    if products:
        cond = cond & F.col("name").isin(list(products))
    if start is not None:
        cond = cond & (F.col("date") >= start)
    if end is not None:
        cond = cond & (F.col("date") <= end)
    if severity != "All":
        cond = cond & (F.col("severity") == severity)
    return records.filter(cond & (F.col("riskProbability") >= threshold))


# ---- joins --------------------------------------------------------------------------


def join_predictions(products: DataFrame, predictions: DataFrame) -> DataFrame:
    """products LEFT JOIN predictions on product; missing -> 0 / 0 / Low.
    Both sides are product-level; Spark picks broadcast only under its size
    threshold, else a shuffle join."""
    cols = ["risk_probability", "risk_category", "high_risk_predicted"]
    base = products.drop(*[c for c in cols if c in products.columns])
    j = base.join(predictions.select("product", *cols), "product", "left")
    return j.na.fill({"risk_probability": 0.0, "high_risk_predicted": 0, "risk_category": "Low"})


def reviews_of_products(reviews: DataFrame, products: DataFrame) -> DataFrame:
    """Reviews whose product is in the (filtered) product table: left semi join."""
    return reviews.join(products.select("product"), "product", "left_semi")


def review_count_window(reviews: DataFrame, value: str = "impact_score") -> DataFrame:
    """Per-product count of non-null ``value`` attached to every review
    (aggregate + join instead of a product-partitioned window)."""
    counts = reviews.groupBy("product").agg(F.count(value).alias("review_count"))
    return reviews.join(counts, "product", "left")


# ---- aggregates / KPIs ------------------------------------------------------------


def revenue_at_risk(reviews: DataFrame) -> DataFrame:
    risky = F.col("rating") <= K.RISKY_MAX_RATING
    return reviews.agg(
        F.coalesce(C.money_sum(F.when(risky, F.col("customer_ltv"))), F.lit(0.0)).alias("total_rev_risk"),
        F.count_if(risky).alias("num_risky_reviews"),
        F.coalesce(C.money_avg(F.when(risky, F.col("customer_ltv"))), F.lit(0.0))
        .alias("avg_ltv_per_risk"))


def summary_stats(reviews: DataFrame, products: DataFrame | None = None) -> DataFrame:
    risky = F.col("rating") <= K.RISKY_MAX_RATING
    n = F.count(F.lit(1))
    r = reviews.agg(
        n.alias("total_reviews"),
        F.coalesce(C.money_sum(F.when(risky, F.col("customer_ltv"))), F.lit(0.0))
        .alias("total_revenue_at_risk"),
        F.count_if(risky).alias("risky_reviews"),
        F.coalesce(C.money_avg(F.when(risky, F.col("customer_ltv"))), F.lit(0.0))
        .alias("avg_ltv_per_risky_review"),
        F.avg("rating").alias("avg_rating"),
        (C.safe_ratio(F.sum("repeat"), n) * 100.0).alias("repeat_customer_pct"),
        (C.safe_ratio(F.sum("verified"), n) * 100.0).alias("verified_purchase_pct"))
    if products is None:
        return r
    p = products.agg(
        F.count(F.lit(1)).alias("total_products"),
        F.avg("final_score").alias("avg_final_score"),
        F.max("final_score").alias("max_final_score"),
        F.count_if(F.col("quadrant") == K.FIRE_FIGHT).alias("critical_products"),
        F.count_if(F.col("quadrant") == K.VIP_NUDGE).alias("vip_products"))
    return r.crossJoin(p)


def top_product(products: DataFrame, key: str = "final_score") -> DataFrame:
    """One row: product with the largest ``key`` (ties: first name), 'N/A' if none."""
    return products.agg(F.coalesce(_first_by_max("product", key), F.lit("N/A"))
                        .alias("top_product"))


def kpis(reviews: DataFrame, products: DataFrame) -> DataFrame:
    """Revenue at risk, reviews, negative %, top product by score, High count."""
    r = reviews.agg(F.count(F.lit(1)).alias("total_reviews"),
                    F.coalesce(F.sum("is_negative"), F.lit(0)).alias("__neg"))
    has_cat = "risk_category" in products.columns
    p = products.agg(
        F.coalesce(C.money_sum("total_revenue_at_risk"), F.lit(0.0)).alias("total_revenue_at_risk"),
        (F.count_if(F.col("risk_category") == "High") if has_cat else F.lit(0).cast("bigint"))
        .alias("high_risk_count"),
        F.coalesce(_first_by_max("product", "final_score"), F.lit("N/A")).alias("top_product"))
    out = r.crossJoin(p)
    return out.select("total_revenue_at_risk", "total_reviews",
                      (C.safe_ratio("__neg", "total_reviews") * 100.0).alias("negative_pct"),
                      "top_product", "high_risk_count")


def _first_by_max(value: str, key: str) -> F.Column:
    """Value at the max ``key``; ties broken by the smallest value (deterministic);
    rows with a null key are skipped."""
    order = F.when(F.col(key).isNotNull(),
                   F.struct((-F.col(key)).alias("k"), F.col(value).alias("v")))
    return F.min_by(F.col(value), order)


def kpis_enhanced(reviews: DataFrame, products: DataFrame) -> DataFrame:
    base = kpis(reviews, products)
    extra = products.agg(F.count_if(F.col("risk_category") == "Medium").alias("medium_risk_count"),
                         F.coalesce(F.avg("risk_probability"), F.lit(0.0))
                         .alias("avg_risk_probability"))
    return base.crossJoin(extra)


def kpis_weighted(records: DataFrame) -> DataFrame:
    """On product records: revenue, reviews, review-weighted negative %, mean
    probability, High count, and the baseline note (.22)."""
    one = records.agg(
        F.coalesce(F.sum("revenueAtRisk"), F.lit(0)).alias("total_revenue"),
        F.coalesce(F.sum("totalReviews"), F.lit(0)).alias("total_reviews"),
        F.sum(F.col("negativePct") / 100.0 * F.col("totalReviews")).alias("__wneg"),
        F.coalesce(F.avg("riskProbability"), F.lit(0.0)).alias("avg_probability"),
        F.count_if(F.col("severity") == "High").alias("high_risk_count"),
        F.count(F.lit(1)).alias("products_in_view"))
    wneg = F.when(F.col("total_reviews") > 0, F.col("__wneg") / F.col("total_reviews")).otherwise(0.0)
    return one.select("total_revenue", "total_reviews", (wneg * 100.0).alias("negative_pct"),
                      "avg_probability", "high_risk_count", "products_in_view",
                      F.when(wneg > K.NEGATIVE_BASELINE, "Above baseline").otherwise("Within baseline")
                      .alias("negative_note"))


def ml_insight_kpis(products: DataFrame, threshold: float = K.HIDDEN_RISK_MIN) -> DataFrame:
    high = F.col("risk_probability") > threshold
    return products.agg(
        F.count_if(high & (F.col("quadrant") != K.FIRE_FIGHT)).alias("hidden_risks"),
        F.avg("risk_probability").alias("portfolio_risk"),
        F.coalesce(C.money_sum(F.when(high, F.col("total_revenue_at_risk"))), F.lit(0.0))
        .alias("high_risk_revenue"))


def risk_summary(products: DataFrame) -> DataFrame:
    return products.agg(
        F.count_if(F.col("risk_category") == "High").alias("high_risk_count"),
        F.count_if(F.col("risk_category") == "Medium").alias("medium_risk_count"),
        F.count_if(F.col("risk_category") == "Low").alias("low_risk_count"),
        F.avg("risk_probability").alias("avg_risk_probability"),
        _first_by_max("product", "risk_probability").alias("max_risk_product"),
        F.max("risk_probability").alias("max_risk_probability"))


def issue_breakdown(reviews: DataFrame) -> DataFrame:
    """Complaints (rating <= 3): product x category counts, fixed pivot list,
    missing 0, with the total for ordering."""
    p = (complaint_reviews(reviews).groupBy("product").pivot("issue_category", K.ISSUE_CATEGORIES)
         .count().na.fill(0))
    total = None
    for c in K.ISSUE_CATEGORIES:
        total = F.col(c) if total is None else total + F.col(c)
    return p.withColumn("total", total).orderBy(F.col("total").desc(), "product")


def risk_distribution(products: DataFrame, col: str = "risk_probability",
                      preset: str = "chart") -> DataFrame:
    """Count and share of products per band (null probabilities dropped)."""
    banded = products.filter(F.col(col).isNotNull()).withColumn("band", C.risk_band(col, preset))
    counts = banded.groupBy("band").agg(F.count(F.lit(1)).alias("products"))
    tot = counts.agg(F.sum("products").alias("__total"))
    return with_stats(counts, tot).select("band", "products",
                                          (F.col("products") / F.col("__total")).alias("share"))


def severity_distribution(records: DataFrame) -> DataFrame:
    counts = records.groupBy("severity").agg(F.count(F.lit(1)).alias("products"))
    tot = counts.agg(F.sum("products").alias("__total"))
    return with_stats(counts, tot).select("severity", "products",
                                          (F.col("products") / F.col("__total")).alias("share"))


def distinct_products(reviews: DataFrame) -> DataFrame:
    """Sorted distinct trimmed names, without blanks and 'Unknown'."""
    p = C.strip_ws(F.coalesce(F.col("product").cast("string"), F.lit("Unknown")))
    return (reviews.select(p.alias("product")).distinct()
            .filter((F.col("product") != "") & (F.col("product") != "Unknown"))
            .orderBy("product"))


def date_bounds(reviews: DataFrame, col: str = "review_date") -> DataFrame:
    """Min / max date; both fall back to now-30d .. now when no date parses."""
    d = timestamp_of(reviews, col)
    one = reviews.agg(F.min(d).alias("__mn"), F.max(d).alias("__mx"))
    now = F.localtimestamp()
    missing = F.col("__mn").isNull() | F.col("__mx").isNull()
    return one.select(
        F.when(missing, now - F.expr("INTERVAL 30 DAYS")).otherwise(F.col("__mn")).alias("min_date"),
        F.when(missing, now).otherwise(F.col("__mx")).alias("max_date"))


def issue_totals(records: DataFrame) -> DataFrame:
    """Sum of each issue key across product records."""
    kv = records.select(F.explode(F.map_from_arrays(
        F.array(*[F.lit(k) for k, _ in K.ISSUE_SPLIT]),
        F.array(*[F.col(f"issues.{k}") for k, _ in K.ISSUE_SPLIT]))).alias("issue", "n"))
    return kv.groupBy("issue").agg(F.sum("n").alias("total"))


def top_two_issues(records: DataFrame) -> DataFrame:
    return issue_totals(records).orderBy(F.col("total").desc(), F.col("issue")).limit(2)


def top_issue(records: DataFrame) -> DataFrame:
    """Largest issue key per product record (ties: first key in order)."""
    keys = [k for k, _ in K.ISSUE_SPLIT]
    best = F.lit(keys[0])
    best_v = F.col(f"issues.{keys[0]}")
    for k in keys[1:]:
        v = F.col(f"issues.{k}")
        best = F.when(v > best_v, F.lit(k)).otherwise(best)
        best_v = F.greatest(best_v, v)
    return records.select("name", best.alias("top_issue"))


# ---- rankings -----------------------------------------------------------------------


def tie_break(df: DataFrame, name_col: str) -> list[F.Column]:
    """Records arrive in score order and the client's sort is stable: equal keys keep
    that order. ``score`` is the records' unrounded final score; equal scores go by name."""
    return ([F.col("score").desc()] if "score" in df.columns else []) + [F.col(name_col).asc()]


def top_n(df: DataFrame, key: str, n: int, name_col: str = "product") -> DataFrame:
    return df.orderBy(F.col(key).desc(), *tie_break(df, name_col)).limit(n)


def top3_flag(products: DataFrame) -> DataFrame:
    """Mark the 3 products with the largest revenue at risk (ties by name)."""
    top = top_n(products, "total_revenue_at_risk", 3).select("product",
                                                             F.lit(True).alias("is_top3"))
    j = products.join(F.broadcast(top), "product", "left")
    return j.withColumn("is_top3", F.coalesce(F.col("is_top3"), F.lit(False)))


def revenue_ranking(products: DataFrame) -> DataFrame:
    cols = ["product", "total_revenue_at_risk"] + (
        ["risk_probability"] if "risk_probability" in products.columns else [])
    return products.select(*cols).orderBy(F.col("total_revenue_at_risk").desc(), "product")


SORT_KEYS = {"name": "name", "score": "finalScore", "revenue": "revenueAtRisk",
             "probability": "riskProbability", "negative": "negativePct",
             "quadrant": "quadrant", "trend": "trend"}


def sort_records(records: DataFrame, key: str = "score", direction: str = "desc") -> DataFrame:
    c = F.col(SORT_KEYS[key])
    return records.orderBy(c.asc() if direction == "asc" else c.desc(), *tie_break(records, "name"))


def preview(reviews: DataFrame, n: int = 20, order_by: list[str] | None = None) -> DataFrame:
    cols = [c for c in ["product", "rating", "review_text", "issue_severity", "is_negative",
                        "impact_score"] if c in reviews.columns]
    keys = order_by or ["impact_score", "product"]
    return reviews.select(*cols).orderBy(*[F.col(k).desc() if k == "impact_score" else F.col(k)
                                           for k in keys]).limit(n)


# ---- product records ----------------------------------------------------------------


def dashboard_records(products: DataFrame, as_of: str | None = None) -> DataFrame:
    """Client product records, with the unrounded ``score`` for ties: final score min-max'd over products (range 1
    when constant, clamped), revenue truncated to int, negative %, quadrant,
    frequency, impact %, rating, severity band, estimated issue split."""
    mm = products.agg(F.min("final_score").alias("__mn"), F.max("final_score").alias("__mx"))
    j = with_stats(products, mm)
    rng = F.when(F.col("__mx") > F.col("__mn"), F.col("__mx") - F.col("__mn")).otherwise(1.0)
    norm = C.clip01((F.col("final_score") - F.col("__mn")) / rng)
    day = F.lit(as_of) if as_of else F.date_format(F.current_date(), "yyyy-MM-dd")
    rating_src = "avg_rating" if "avg_rating" in products.columns else None
    return j.select(
        F.col("product").cast("string").alias("name"),
        day.alias("date"),
        C.round_even(norm, 2).alias("finalScore"),
        C.trunc_money("total_revenue_at_risk").alias("revenueAtRisk"),
        C.round_even(norm, 2).alias("riskProbability"),
        C.round_even(F.col("negative_ratio") * 100.0, 1).alias("negativePct"),
        F.col("quadrant"),
        F.col("total_reviews").cast("long").alias("frequency"),
        C.impact_pct("total_revenue_at_risk").alias("impact"),
        C.round_even(F.col(rating_src) if rating_src else F.lit(3.0), 1).alias("rating"),
        F.lit("Stable").alias("trend"),
        C.severity_band(norm).alias("severity"),
        F.col("total_reviews").cast("long").alias("totalReviews"),
        C.issue_split("total_reviews").alias("issues"),
        F.col("final_score").cast("double").alias("score"))


def format_ranking(products: DataFrame) -> DataFrame:
    """Display table: score 3 dp, rating 2 dp, ratio 'x.x%', revenue as a whole
    rupee amount, risk 'x.x%' and status label; only available columns."""
    want = ["product", "total_reviews", "avg_rating", "negative_ratio", "final_score",
            "total_revenue_at_risk", "quadrant"]
    cols = []
    for c in want:
        if c not in products.columns:
            continue
        if c == "final_score":
            cols.append(C.round_even(F.col(c), 3).alias(c))
        elif c == "avg_rating":
            cols.append(C.round_even(F.col(c), 2).alias(c))
        elif c == "negative_ratio":
            cols.append(F.concat(C.round_even(F.col(c) * 100.0, 1).cast("string"), F.lit("%"))
                        .alias(c))
        elif c == "total_revenue_at_risk":
            cols.append(F.concat(F.lit("₹"), F.bround(F.col(c), 0).cast("long").cast("string"))
                        .alias(c))
        else:
            cols.append(F.col(c))
    if "risk_probability" in products.columns:
        cols.append(F.concat(C.round_even(F.col("risk_probability") * 100.0, 1).cast("string"),
                             F.lit("%")).alias("risk_pct"))
        if "risk_category" in products.columns:
            rc = F.col("risk_category")
            cols.append(F.when(rc == "Low", "Low").when(rc == "Medium", "Medium")
                        .otherwise("High").alias("risk_status"))
    if "final_score" in products.columns:
        products = products.orderBy(F.col("final_score").desc(), "product")
    return products.select(*cols)


def rating_vs_risk_data(products: DataFrame) -> DataFrame:
    d = products.select("product", "avg_rating", "risk_probability").na.drop()
    return d.select("*", C.risk_band("risk_probability", "chart").alias("band"),
                    C.round_even(F.col("risk_probability") * 100.0, 1).alias("risk_pct"))
