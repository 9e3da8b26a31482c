"""The older ("classic") scoring path: preprocessing, features, scores and the
score validation check. Same shape as the live path: statistics observed
while the input is written once, everything else row-local expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.functions import columns as C
from revlens.functions import constants as K
from revlens.functions.stats import observed_minmax, with_stats
from revlens.operators.reviews import numeric_columns


def classic_preprocess(df: DataFrame) -> DataFrame:
    """Fill ltv/order/votes 0 and days 30, log scale, epsilon min-max (no clip,
    constant -> 0), flags -> int, then every remaining null -> 0 ('0' for text)."""
    df = df.withColumns({
        "customer_ltv": F.coalesce(C.to_double("customer_ltv"), F.lit(0.0)),
        "order_value": F.coalesce(C.to_double("order_value"), F.lit(0.0)),
        "helpful_votes": F.coalesce(C.to_double("helpful_votes"), F.lit(0.0)),
        "days_since_purchase": F.coalesce(C.to_double("days_since_purchase"), F.lit(30.0)),
    }).withColumns({"ltv_log": C.log_scale("customer_ltv"),
                    "order_value_log": C.log_scale("order_value")})
    df, bounds = observed_minmax(df, {"ltv": "ltv_log", "order": "order_value_log", "helpful": "helpful_votes"})
    out = df.select(
        "*", C.minmax_eps("ltv_log", *bounds["ltv"]).alias("ltv_norm"),
        C.minmax_eps("order_value_log", *bounds["order"]).alias("order_norm"),
        C.minmax_eps("helpful_votes", *bounds["helpful"]).alias("helpful_norm"),
        C.flag_to_int("is_repeat_customer", df.schema["is_repeat_customer"].dataType).alias("repeat"),
        C.flag_to_int("verified_purchase", df.schema["verified_purchase"].dataType).alias("verified"))
    out = out.na.fill(0, subset=numeric_columns(out))
    strs = [f.name for f in out.schema.fields if isinstance(f.dataType, T.StringType)]
    return out.na.fill("0", subset=strs) if strs else out


def classic_features(df: DataFrame) -> DataFrame:
    """severity_rating, recency (plain decay), sentiment_score (map, default .5),
    is_negative; nulls -> 0."""
    sent = (C.sentiment_to_score("sentiment") if "sentiment" in df.columns
            else F.lit(K.SENTIMENT_DEFAULT))
    return df.withColumns({
        "severity_rating": F.coalesce(C.severity_rating("rating"), F.lit(0.0)),
        "recency": F.coalesce(C.recency_decay("days_since_purchase"), F.lit(0.0)),
        "sentiment_score": F.coalesce(sent, F.lit(0.0)),
        "is_negative": C.is_negative("rating"),
    })


def classic_scores(df: DataFrame) -> DataFrame:
    """CIS with plain recency; severity ``.6 sr + .4 (1 - sentiment)``; impact =
    product taken before clipping, no rating gate; clip; nulls -> 0."""
    w = K.CIS_WEIGHTS
    cis = (w["ltv_norm"] * F.col("ltv_norm") + w["order_norm"] * F.col("order_norm")
           + w["repeat"] * F.col("repeat") + w["verified"] * F.col("verified")
           + w["helpful_norm"] * F.col("helpful_norm") + w["recency_score"] * F.col("recency"))
    sev = (K.SEVERITY_RATING_WEIGHT * F.col("severity_rating")
           + K.SEVERITY_SENTIMENT_WEIGHT * (F.lit(1.0) - F.col("sentiment_score")))
    return df.withColumns({
        "CIS": F.coalesce(C.clip01(cis), F.lit(0.0)),
        "severity": F.coalesce(C.clip01(sev), F.lit(0.0)),
        "impact_score": F.coalesce(C.clip01(cis * sev), F.lit(0.0)),
    })


def score_validation(df: DataFrame) -> DataFrame:
    """One row: mean impact of high- vs low-LTV reviews (split at the median LTV
    of all reviews) among rating <= 2, their ratio, range and null checks, and
    ``passed``. The median is an exact quantile (bounded selection)."""
    from revlens.functions.stats import quantiles

    med = quantiles(df, [("ltv_median", "customer_ltv", 0.5)])
    j = with_stats(df, med)
    low = F.col("rating") <= 2
    hi_ltv = F.col("customer_ltv") >= F.col("ltv_median")
    one = j.agg(
        F.avg(F.when(low & hi_ltv, F.col("impact_score"))).alias("high_ltv_avg_impact"),
        F.avg(F.when(low & ~hi_ltv, F.col("impact_score"))).alias("low_ltv_avg_impact"),
        F.count_if(~F.col("CIS").between(0, 1)).alias("cis_out_of_range"),
        F.count_if(~F.col("severity").between(0, 1)).alias("severity_out_of_range"),
        F.count_if(~F.col("impact_score").between(0, 1)).alias("impact_out_of_range"),
        (F.count_if(F.col("CIS").isNull()) + F.count_if(F.col("severity").isNull())
         + F.count_if(F.col("impact_score").isNull())).alias("null_scores"),
    )
    ratio = F.when(F.col("low_ltv_avg_impact") > 0,
                   F.col("high_ltv_avg_impact") / F.col("low_ltv_avg_impact"))
    one = one.withColumn("high_ltv_vs_low_ltv", ratio)
    passed = ((F.coalesce(F.col("high_ltv_vs_low_ltv") > 1.0, F.lit(True)))
              & (F.col("cis_out_of_range") == 0) & (F.col("severity_out_of_range") == 0)
              & (F.col("impact_out_of_range") == 0) & (F.col("null_scores") == 0))
    return one.withColumn("passed", passed)
