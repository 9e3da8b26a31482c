"""Product-level operators: aggregation, priority, final score, quadrants,
classic decisions and spike detection.

Scale notes
* Every per-product metric comes from ONE ``groupBy("product").agg``: partial
  (map-side) aggregation absorbs a hot product before the shuffle. The
  reference's extra group-bys and merges (counts, negative counts, revenue)
  are conditional aggregates in that same pass: no join.
* Product-level min/max and quantiles are one-row frames broadcast back.
  Quantiles use the bounded exact selection in ``functions.stats``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.functions import columns as C
from revlens.functions import constants as K
from revlens.functions.stats import minmax_stats, quantiles, with_stats
from revlens.session import written


def clean_products(df: DataFrame, missing: str = "General") -> DataFrame:
    """Product column present, null -> 'Unknown', trimmed, blanks dropped; LTV numeric."""
    if "product" not in df.columns:
        df = df.withColumn("product", F.lit(missing))
    ltv = (F.coalesce(C.to_double(F.col("customer_ltv")), F.lit(0.0))
           if "customer_ltv" in df.columns else F.lit(0.0))
    df = df.withColumns({
        "product": C.strip_ws(F.coalesce(F.col("product").cast("string"), F.lit("Unknown"))),
        "customer_ltv": ltv,
    })
    return df.filter(F.col("product") != "")


def product_metrics(scored: DataFrame, risky_max: float = K.RISKY_MAX_RATING,
                    materialize: bool = True) -> DataFrame:
    """Per product: total impact, mean rating, repeat rate, mean and total LTV,
    mean order value, review count, negative count/ratio and revenue at risk
    (rating <= 2.5), all in one aggregate.

    The product table is read several times downstream (priority min/max, quantile
    passes, the final projection), each of which would otherwise re-run the whole
    review pipeline; by default it is written once to the shared folder (it is
    about reviews / products times smaller than the review data)."""
    df = clean_products(scored)
    risky = F.col("rating") <= risky_max
    agg = df.groupBy("product").agg(
        F.sum("impact_score").alias("total_impact"),
        F.avg("rating").alias("avg_rating"),
        F.avg("repeat").alias("repeat_rate"),
        C.money_avg("customer_ltv").alias("avg_customer_ltv"),
        C.money_sum("customer_ltv").alias("total_ltv"),
        C.money_avg("order_value").alias("avg_order_value"),
        F.count(F.lit(1)).alias("total_reviews"),
        F.count_if(risky).alias("negative_count"),
        F.coalesce(C.money_sum(F.when(risky, F.col("customer_ltv"))), F.lit(0.0))
        .alias("total_revenue_at_risk"),
    )
    out = agg.withColumns({
        "negative_ratio": F.col("negative_count") / F.col("total_reviews"),
        "revenue_at_risk": F.col("total_revenue_at_risk"),
    })
    return written(out, "products") if materialize else out


def _clip01_sql(x: str) -> str:
    return f"(CASE WHEN ({x}) < 0 THEN 0.0D WHEN ({x}) > 1 THEN 1.0D ELSE ({x}) END)"


def product_priority(products: DataFrame) -> DataFrame:
    """PPS: weighted min-max'd frequency, order value, repeat rate, rating drop and
    negative ratio (constant column -> 0), clipped to [0, 1]. Expressions are
    passed as SQL text (one parse each)."""
    w = K.PPS_WEIGHTS
    parts = {"freq": "cast(total_reviews as double)", "order": "cast(avg_order_value as double)",
             "repeat": "cast(repeat_rate as double)", "rating_drop": "(5.0D - avg_rating)",
             "negative": "cast(negative_ratio as double)"}
    stats = products.agg(*[F.expr(f"{fn}({e}) AS __{fn}_{k}") for k, e in parts.items()
                           for fn in ("min", "max")])
    j = with_stats(products, stats)
    terms = []
    for k, e in parts.items():
        mn, mx = f"__min_{k}", f"__max_{k}"
        norm = _clip01_sql(f"({e} - {mn}) / ({mx} - {mn} + {K.MINMAX_EPS!r})")
        terms.append(f"{w[k]!r} * (CASE WHEN {mx} = {mn} THEN 0.0D ELSE {norm} END)")
    keep = [f"`{c}`" for c in products.columns if c != "PPS"]
    return j.selectExpr(*keep, f"{_clip01_sql(' + '.join(terms))} AS PPS")


def final_score(products: DataFrame) -> DataFrame:
    """``ln(1 + total_impact) * (1 + PPS)``."""
    return products.withColumn("final_score",
                               C.log_scale("total_impact") * (F.lit(1.0) + F.col("PPS")))


def product_scores(scored: DataFrame) -> DataFrame:
    return final_score(product_priority(product_metrics(scored)))


def rank_products(products: DataFrame, key: str = "final_score") -> DataFrame:
    """Descending by score, product name as the tie-break (a distributed sort)."""
    return products.orderBy(F.col(key).desc(), F.col("product").asc())


def quadrant_thresholds(products: DataFrame, q: float = K.QUADRANT_QUANTILE,
                        method: str = "bracket") -> DataFrame:
    return quantiles(products, [("p75_revenue", "total_revenue_at_risk", q),
                                ("p75_negative", "negative_ratio", q),
                                ("p75_impact", "total_impact", q)], method=method)


def classify_quadrants(products: DataFrame, method: str = "bracket") -> DataFrame:
    """Strict comparisons against the 75th percentiles of revenue at risk,
    negative ratio and total impact."""
    if "total_revenue_at_risk" not in products.columns:
        src = (F.col("revenue_at_risk") if "revenue_at_risk" in products.columns
               else F.lit(0.0))
        products = products.withColumn("total_revenue_at_risk", src)
    th = quadrant_thresholds(products, method=method)
    quad = ("CASE WHEN total_revenue_at_risk > p75_revenue AND negative_ratio > p75_negative "
            f"THEN '{K.FIRE_FIGHT}' "
            "WHEN total_impact > p75_impact AND negative_ratio < p75_negative "
            f"THEN '{K.VIP_NUDGE}' "
            "WHEN total_revenue_at_risk < p75_revenue AND negative_ratio > p75_negative "
            f"THEN '{K.SLOW_BURN}' ELSE '{K.NOISE}' END")
    acts = " ".join(f"WHEN '{q}' THEN '{a}'" for q, a in K.QUADRANT_ACTIONS.items())
    keep = [f"`{c}`" for c in products.columns if c not in ("quadrant", "action")]
    j = with_stats(products, th).selectExpr(*keep, f"{quad} AS quadrant")
    return j.selectExpr(*keep, "quadrant", f"CASE quadrant {acts} END AS action")


def quadrant_priority(products: DataFrame) -> DataFrame:
    return products.withColumn(
        "priority", F.when(F.col("quadrant").isin(K.FIRE_FIGHT, K.VIP_NUDGE), "High")
        .otherwise("Low"))


def quadrant_chart_data(products: DataFrame, method: str = "bracket") -> DataFrame:
    """Product points with both p75 threshold lines as columns."""
    th = quantiles(products, [("x_threshold", "negative_ratio", K.QUADRANT_QUANTILE),
                              ("y_threshold", "total_revenue_at_risk", K.QUADRANT_QUANTILE)],
                   method=method)
    return with_stats(products.select("product", "negative_ratio", "total_revenue_at_risk",
                                      "final_score", "quadrant"), th)


def make_decisions(products: DataFrame, method: str = "bracket") -> DataFrame:
    """Classic rules, in order: >= p75 revenue and >= p75 negative ratio; >= p75
    impact; <= p25 rating; negative ratio > .3; else Monitor. Priority from the
    p75 of the final score (>= High, >= half Medium, else Low)."""
    th = quantiles(products, [("t_rev", "total_revenue_at_risk", K.QUADRANT_QUANTILE),
                              ("t_imp", "total_impact", K.QUADRANT_QUANTILE),
                              ("t_neg", "negative_ratio", K.QUADRANT_QUANTILE),
                              ("t_rating", "avg_rating", K.RATING_QUANTILE_LOW),
                              ("t_score", "final_score", K.QUADRANT_QUANTILE)], method=method)
    r = F.col
    action = (F.when((r("total_revenue_at_risk") >= r("t_rev"))
                     & (r("negative_ratio") >= r("t_neg")), K.DECISION_FIX)
              .when(r("total_impact") >= r("t_imp"), K.DECISION_INVESTIGATE)
              .when(r("avg_rating") <= r("t_rating"), K.DECISION_IMPROVE)
              .when(r("negative_ratio") > K.RESPOND_NEGATIVE_RATIO, K.DECISION_RESPOND)
              .otherwise(K.DECISION_MONITOR))
    priority = (F.when(r("final_score") >= r("t_score"), "High")
                .when(r("final_score") >= r("t_score") * 0.5, "Medium").otherwise("Low"))
    keep = [F.col(c) for c in products.columns if c not in ("action", "priority")]
    j = with_stats(products, th)
    return j.select(*keep, action.alias("action"), priority.alias("priority"))


def to_timestamp_lenient(c) -> F.Column:
    """``pd.to_datetime(errors='coerce')`` for timestamp or text input."""
    return F.coalesce(F.try_to_timestamp(C.col_(c).cast("string")),
                      C.col_(c).try_cast("timestamp"))


def timestamp_of(df: DataFrame, name: str = "review_date") -> F.Column:
    """The column as a (zone-less) timestamp; text is parsed leniently."""
    dt = df.schema[name].dataType
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.col(name).cast("timestamp_ntz")
    return to_timestamp_lenient(name).cast("timestamp_ntz")


_ts = timestamp_of


def spike_stats(reviews: DataFrame) -> DataFrame:
    """Per product: reviews within 14 days of the global latest date, and the
    spike score ``(recent - n/2.14) / (n/4.3 + 1e-9)``."""
    df = reviews.filter(F.col("product").isNotNull()).withColumn("__d", _ts(reviews))
    mx = df.agg(F.max("__d").alias("__max_d"))
    j = with_stats(df, mx)
    recent = F.col("__d") >= F.col("__max_d") - F.expr(f"INTERVAL {K.SPIKE_WINDOW_DAYS} DAYS")
    agg = j.groupBy("product").agg(F.count_if(recent).alias("recent_14"),
                                   F.count(F.lit(1)).alias("total_reviews_30"))
    n = F.col("total_reviews_30").cast("double")
    return agg.withColumn("spike_score", (F.col("recent_14") - n / K.SPIKE_RECENT_DIVISOR)
                          / (n / K.SPIKE_SPREAD_DIVISOR + 1e-9))


def classic_product_metrics(reviews: DataFrame, materialize: bool = True) -> DataFrame:
    """Classic aggregation: severity mean, negative ratio = mean(is_negative),
    revenue at risk = sum(LTV * is_negative), PPS with clipped epsilon min-max,
    zero-impact gate, spike boost; ten output columns, nulls -> 0."""
    df = reviews.filter(F.col("product").isNotNull())
    has_date = "review_date" in df.columns
    aggs = [
        F.count(F.lit(1)).alias("total_reviews"),
        F.sum("impact_score").alias("total_impact"),
        F.avg("severity").alias("avg_severity"),
        F.avg("is_negative").alias("negative_ratio"),
        C.money_avg("customer_ltv").alias("avg_customer_ltv"),
        C.money_avg("order_value").alias("avg_order_value"),
        F.avg("repeat").alias("repeat_rate"),
        F.avg("rating").alias("avg_rating"),
        C.money_sum(F.col("customer_ltv") * F.col("is_negative")).alias("total_revenue_at_risk"),
    ]
    if has_date:
        df = df.withColumn("__d", _ts(df))
        mx = df.agg(F.max("__d").alias("__max_d"))
        df = with_stats(df, mx)
        recent = F.col("__d") >= F.col("__max_d") - F.expr(
            f"INTERVAL {K.SPIKE_WINDOW_DAYS} DAYS")
        aggs += [F.count_if(recent).alias("__recent"), F.max("__max_d").alias("__max_d")]
    p = df.groupBy("product").agg(*aggs).withColumns({
        "order_freq": F.col("total_reviews").cast("double"),
        "rating_drop": F.lit(5.0) - F.col("avg_rating"),
    })
    feats = ["order_freq", "avg_order_value", "repeat_rate", "rating_drop", "negative_ratio"]
    stats = minmax_stats(p, {f: f for f in feats})
    p = with_stats(p, stats)
    w = K.PPS_WEIGHTS
    names = dict(zip(feats, ["freq", "order", "repeat", "rating_drop", "negative"]))
    pps = None
    for f in feats:
        t = w[names[f]] * C.minmax_eps(f, f"__min_{f}", f"__max_{f}", clip_result=True)
        pps = t if pps is None else pps + t
    p = p.withColumn("PPS", C.clip01(pps))
    score = F.when(F.col("total_impact") == 0, F.lit(0.0)).otherwise(
        C.log_scale("total_impact") * (F.lit(1.0) + F.col("PPS")))
    if has_date:
        n = F.col("total_reviews").cast("double")
        spike = F.when(F.col("__max_d").isNull(), F.lit(None)).otherwise(
            (F.col("__recent") - n / K.SPIKE_RECENT_DIVISOR) / (n / K.SPIKE_SPREAD_DIVISOR + 1e-9))
        score = F.when(F.coalesce(spike, F.lit(0.0)) > K.SPIKE_THRESHOLD,
                       score * K.SPIKE_MULTIPLIER).otherwise(score)
    p = p.withColumn("final_score", score)
    out = ["product", "total_reviews", "avg_order_value", "avg_rating", "negative_ratio",
           "repeat_rate", "total_impact", "PPS", "total_revenue_at_risk", "final_score"]
    p = p.select(*out).na.fill(0)
    return written(p, "products") if materialize else p
