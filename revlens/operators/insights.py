"""Insight columns for the top products.

The reference calls a remote language model per product. Here that is
re-aimed: the payload goes out as a column (``insight_payload``), replies come
back as a table (``merge_insights``), and the deterministic rule-based text is
built with Spark string functions. Only the top ``n`` products by final score
get insights; ``n`` is a literal, so the top-N step is a bounded
``orderBy().limit(n)`` joined back by broadcast.

Number formatting uses ``format_number`` (HALF_EVEN on the exact binary value,
like Python's ``format``), not ``format_string`` (half-up).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.functions import columns as C
from revlens.functions import constants as K

INSIGHT_COLUMNS = ["llm_summary", "llm_driver", "llm_recommendation", "llm_source", "llm_payload"]
REPLY_SCHEMA = T.StructType([T.StructField("summary", T.StringType()),
                             T.StructField("driver", T.StringType()),
                             T.StructField("recommendation", T.StringType())])


def _txt(name: str, df: DataFrame, default: str = "Unknown") -> F.Column:
    return (F.coalesce(F.col(name).cast("string"), F.lit(default)) if name in df.columns
            else F.lit(default))


def _num(name: str, df: DataFrame, digits: int) -> F.Column:
    v = F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in df.columns else F.lit(0.0)
    return C.round_even(v, digits)


def payload_struct(df: DataFrame) -> F.Column:
    """Rounded metrics with keys in alphabetical order; risk fields only when
    the product table has them."""
    fields = {
        "action": _txt("action", df),
        "avg_rating": _num("avg_rating", df, 3),
        "final_score": _num("final_score", df, 4),
        "negative_ratio": _num("negative_ratio", df, 4),
        "priority": _txt("priority", df),
        "product": _txt("product", df),
        "quadrant": _txt("quadrant", df),
        "total_impact": _num("total_impact", df, 4),
        "total_revenue_at_risk": _num("total_revenue_at_risk", df, 2),
        "total_reviews": (F.coalesce(F.col("total_reviews").cast("long"), F.lit(0))
                          if "total_reviews" in df.columns else F.lit(0).cast("long")),
    }
    if "risk_category" in df.columns:
        fields["risk_category"] = _txt("risk_category", df)
    if "risk_probability" in df.columns:
        fields["risk_probability"] = _num("risk_probability", df, 4)
    return F.struct(*[fields[k].alias(k) for k in sorted(fields)])


def insight_payload(products: DataFrame) -> DataFrame:
    return products.withColumn("llm_payload", F.to_json(payload_struct(products)))


def rule_insight(products: DataFrame) -> DataFrame:
    """Three deterministic sentences from the payload values; source 'rule_based'."""
    p = products.withColumn("__p", payload_struct(products))
    risk = F.col("__p.risk_probability") if "risk_probability" in products.columns else F.lit(0.0)
    summary = F.concat(F.col("__p.product"), F.lit(" is in "), F.col("__p.quadrant"),
                       F.lit(" with priority "), F.col("__p.priority"),
                       F.lit(" and final score "),
                       F.regexp_replace(F.format_number(F.col("__p.final_score"), 3), ",", ""),
                       F.lit("."))
    driver = F.concat(F.lit("Revenue at risk is INR "),
                      F.format_number(F.col("__p.total_revenue_at_risk"), 0),
                      F.lit(", negative ratio is "),
                      F.regexp_replace(F.format_number(F.col("__p.negative_ratio") * 100.0, 1),
                                       ",", ""),
                      F.lit("%, and ML risk probability is "),
                      F.regexp_replace(F.format_number(risk * 100.0, 1), ",", ""),
                      F.lit("%."))
    rec = F.concat(F.lit("Recommended action remains: "), F.col("__p.action"), F.lit("."))
    return p.withColumns({"llm_summary": summary, "llm_driver": driver,
                          "llm_recommendation": rec, "llm_source": F.lit("rule_based"),
                          "llm_payload": F.to_json(F.col("__p"))}).drop("__p")


def top_for_insight(products: DataFrame, n: int = K.INSIGHT_TOP_N) -> DataFrame:
    """Top ``n`` products by final score (ties by name)."""
    return products.orderBy(F.col("final_score").desc(), F.col("product")).limit(max(0, int(n)))


def enrich_products(products: DataFrame, n: int = K.INSIGHT_TOP_N,
                    replies: DataFrame | None = None) -> DataFrame:
    """All products keep their columns; the top ``n`` get the five insight
    columns (model replies where usable, else rule-based), the rest ''."""
    if n <= 0:
        return products.withColumns({c: F.lit("") for c in INSIGHT_COLUMNS})
    top = rule_insight(top_for_insight(products, n))
    if replies is not None:
        top = merge_insights(top, replies)
    top = top.select("product", *INSIGHT_COLUMNS)
    base = products.drop(*[c for c in INSIGHT_COLUMNS if c in products.columns])
    j = base.join(top, "product", "left")  # n is the caller's: Spark sends it only if it is small
    return j.na.fill({c: "" for c in INSIGHT_COLUMNS})


def parse_insight_reply(replies: DataFrame, col: str = "reply") -> DataFrame:
    """Reply JSON -> summary / driver / recommendation (trimmed, missing -> '')."""
    r = F.from_json(F.col(col), REPLY_SCHEMA)
    return replies.withColumns({
        "llm_summary": F.trim(F.coalesce(r.summary, F.lit(""))),
        "llm_driver": F.trim(F.coalesce(r.driver, F.lit(""))),
        "llm_recommendation": F.trim(F.coalesce(r.recommendation, F.lit(""))),
        "__usable": F.get_json_object(F.col(col), "$").isNotNull(),
    })


def merge_insights(rule_based: DataFrame, replies: DataFrame) -> DataFrame:
    """Rule-based rows LEFT JOIN model replies on product (payload must match);
    an unusable reply keeps the rule-based text. Replies are one per product."""
    rp = parse_insight_reply(replies).select(
        "product", F.col("payload").alias("__rp_payload"),
        F.col("llm_summary").alias("__r_summary"), F.col("llm_driver").alias("__r_driver"),
        F.col("llm_recommendation").alias("__r_rec"), "__usable")
    j = rule_based.join(rp, "product", "left")
    use = F.coalesce(F.col("__usable") & (F.col("__rp_payload") == F.col("llm_payload")),
                     F.lit(False))
    return j.withColumns({
        "llm_summary": F.when(use, F.col("__r_summary")).otherwise(F.col("llm_summary")),
        "llm_driver": F.when(use, F.col("__r_driver")).otherwise(F.col("llm_driver")),
        "llm_recommendation": F.when(use, F.col("__r_rec")).otherwise(F.col("llm_recommendation")),
        "llm_source": F.when(use, F.lit("model")).otherwise(F.col("llm_source")),
    }).drop("__rp_payload", "__r_summary", "__r_driver", "__r_rec", "__usable")


def insight_view(products: DataFrame, n: int = 5) -> DataFrame:
    """Rows with a non-empty summary, first ``n`` by final score."""
    return (products.filter(F.col("llm_summary") != "")
            .orderBy(F.col("final_score").desc(), "product").limit(n)
            .select("product", "llm_source", "llm_summary", "llm_driver", "llm_recommendation"))


def product_card_text(records: DataFrame) -> DataFrame:
    """One sentence per product record by severity, with frequency and top issue."""
    from revlens.operators.dashboard import top_issue

    t = top_issue(records)
    j = records.join(t, "name", "left")
    f = F.col("frequency").cast("string")
    txt = (F.when(F.col("severity") == "High", F.concat(
        F.lit("High priority: "), f, F.lit(" issues detected. Top concern: "), F.col("top_issue"),
        F.lit(". Immediate action recommended to prevent revenue loss.")))
        .when(F.col("severity") == "Medium", F.concat(
            F.lit("Medium risk detected with "), f, F.lit(" reported issues. Primary issue: "),
            F.col("top_issue"), F.lit(". Monitor closely for escalation.")))
        .otherwise(F.concat(F.lit("Low risk profile with "), f,
                            F.lit(" issues. Routine follow-up recommended to maintain stability."))))
    return j.select("name", "severity", "frequency", "top_issue", txt.alias("card_text"))


def portfolio_summary(records: DataFrame) -> DataFrame:
    """One row: product with the largest revenue at risk, product with the largest
    impact, and the two largest issue totals, as the summary sentence."""
    from revlens.operators.dashboard import issue_totals

    score = [(-F.col("score")).alias("s")] if "score" in records.columns else []

    def by_max(v, k):  # ties as in ``dashboard.tie_break``
        return F.min_by(F.col(v), F.struct((-F.col(k)).alias("k"), *score, F.col("name").alias("n")))

    tops = records.agg(by_max("name", "revenueAtRisk").alias("top_revenue_product"),
                       F.max("revenueAtRisk").alias("top_revenue"),
                       by_max("riskProbability", "revenueAtRisk").alias("top_revenue_risk"),
                       by_max("name", "impact").alias("top_impact_product"))
    it = issue_totals(records).agg(
        F.sort_array(F.collect_list(F.struct((-F.col("total")).alias("k"),
                                             F.col("issue").alias("issue")))).alias("__ranked"))
    j = tops.crossJoin(it).select(
        "*", F.col("__ranked")[0]["issue"].alias("top_issue"),
        F.col("__ranked")[1]["issue"].alias("secondary_issue"))
    cap = F.concat(F.upper(F.substring("top_issue", 1, 1)), F.lower(F.expr("substring(top_issue, 2)")))
    summary = F.concat(
        F.col("top_revenue_product"), F.lit(" carries the largest revenue exposure at $"),
        F.format_number(F.col("top_revenue").cast("double"), 0),
        F.lit(", driven by elevated "), F.col("top_issue"),
        F.lit(" complaints and a risk probability of "),
        F.regexp_replace(F.format_number(F.col("top_revenue_risk"), 2), ",", ""),
        F.lit(". "), F.col("top_impact_product"),
        F.lit(" remains the highest impact item in the current view, indicating a need for "
              "direct product and support coordination. Across the filtered set, "),
        cap, F.lit(" and "), F.col("secondary_issue"),
        F.lit(" account for most issue volume, while lower-risk products remain commercially "
              "contained. Prioritize immediate remediation on Fire Fight items first, then "
              "address VIP Nudge products where issue frequency is lower but business impact "
              "remains material."))
    return j.select("top_revenue_product", "top_impact_product", "top_issue", "secondary_issue",
                    summary.alias("summary"))


def portfolio_prompt(records: DataFrame) -> DataFrame:
    """The prompt as rows of JSON: one for each record given (``kind`` product) and one with
    the issue totals of all of them (``kind`` issueTotals). No row holds more than a record."""
    from revlens.operators.dashboard import issue_totals

    items = records.select(F.lit("product").alias("kind"), "name", F.to_json(F.struct(
        "name", "revenueAtRisk", "riskProbability", "quadrant", "severity")).alias("prompt"))
    totals = issue_totals(records).groupBy().pivot("issue", [k for k, _ in K.ISSUE_SPLIT]).agg(F.sum("total"))
    return items.union(totals.select(
        F.lit("issueTotals"), F.lit(None).cast("string"),
        F.to_json(F.struct(*[k for k, _ in K.ISSUE_SPLIT]))))
