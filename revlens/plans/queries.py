"""Registered queries: one per operator of the inventory, each ``(spark, sf_dir)
-> DataFrame`` over the driver's tables (or data Spark derives from them).

Doubles are rounded to 6 places at the very end (the oracle does the same).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.operators import products as P
from revlens.operators import reviews as R
from revlens.session import written
from revlens.sources.tables import raw_review_view, review_view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _r6_sql(c: str) -> str:
    """SQL form of ``columns.round6`` (one parse instead of many calls)."""
    return f"rint(rint(`{c}` * 1e9D) / 1e3D) / 1e6D AS `{c}`"


def round6(df: DataFrame) -> DataFrame:
    """Round every double column (top level) to 6 places."""
    out = [_r6_sql(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType))
           else f"`{f.name}`" for f in df.schema.fields]
    return df.selectExpr(*out)


# ---- shared inputs ---------------------------------------------------------------------
# Registered queries over the same tables share the parsed (lazy) views within a
# session: only planning is shared, every query still computes its own result.
_VIEWS: dict = {}


def _view(kind, build, spark, sf):
    key = (kind, spark.sparkContext.applicationId, sf)
    if key not in _VIEWS:
        _VIEWS[key] = build(spark, sf)
    return _VIEWS[key]


def reviews(spark, sf):
    return _view("reviews", review_view, spark, sf)


def raw(spark, sf):
    return _view("raw", raw_review_view, spark, sf)


def norm(spark, sf):
    return _view("norm", lambda s, d: R.normalize_reviews(reviews(s, d)), spark, sf)


def scored(spark, sf):
    """Scored reviews. Not shared: every query reads, joins and writes its own."""
    return R.score_reviews(norm(spark, sf))


def rated(spark, sf):
    """Reviews for queries that need no importance: lazy, without statistics of the whole set."""
    return R.rate_reviews(norm(spark, sf))


def products(spark, sf, of: DataFrame | None = None):
    """Product scores, of reviews that a query has scored already or of all."""
    return P.product_scores(scored(spark, sf) if of is None else of)


def quad(spark, sf, of: DataFrame | None = None):
    return P.quadrant_priority(P.classify_quadrants(products(spark, sf, of)))


# ---- pipelines -------------------------------------------------------------------------
@register("run_pipeline")
def q_run_pipeline(spark, sf):
    return round6(P.rank_products(quad(spark, sf)))


@register("score_reviews")
def q_score_reviews(spark, sf):
    return round6(scored(spark, sf))


@register("product_metrics")
def q_product_metrics(spark, sf):
    return round6(P.product_metrics(scored(spark, sf)))


@register("product_scores")
def q_product_scores(spark, sf):
    return round6(products(spark, sf))


@register("classify_quadrants")
def q_classify_quadrants(spark, sf):
    return round6(P.classify_quadrants(products(spark, sf)))


# ---- §2.3 projections and scalar features ---------------------------------------------
from revlens.functions import columns as C  # noqa: E402
from revlens.operators import classic as CL  # noqa: E402
from revlens.operators import dashboard as D  # noqa: E402

AS_OF = "2024-06-30"


def records(spark, sf):
    return D.dashboard_records(quad(spark, sf), as_of=AS_OF)


def flat_records(df: DataFrame) -> DataFrame:
    keep = [c for c in df.columns if c != "issues"]
    return df.select(*keep, *[F.col(f"issues.{k}").alias(f"issue_{k}")
                              for k in ("delivery", "quality", "packaging", "support")])


def classic_reviews(spark, sf):
    return CL.classic_scores(CL.classic_features(CL.classic_preprocess(reviews(spark, sf))))


@register("log_scale")
def q_log_scale(spark, sf):
    r = raw(spark, sf)
    return round6(r.select("ltv", C.log_scale("ltv").alias("ltv_log"), "order_value",
                           C.log_scale("order_value").alias("order_value_log")))


@register("minmax")
def q_minmax(spark, sf):
    df, bounds = R.column_bounds(reviews(spark, sf).select("helpful_votes", "days_since_purchase"))
    df = R.minmax_column(df, "helpful_votes", "helpful_norm", "const0", bounds=bounds["helpful_votes"])
    return round6(R.minmax_column(df, "days_since_purchase", "days_norm", "const0",
                                  bounds=bounds["days_since_purchase"]))


@register("minmax_safe")
def q_minmax_safe(spark, sf):
    df, bounds = R.column_bounds(norm(spark, sf).select("helpful_votes", "sentiment_score"))
    df = R.minmax_column(df, "helpful_votes", "helpful_norm", "safe", bounds=bounds["helpful_votes"])
    return round6(R.minmax_column(df, "sentiment_score", "sentiment_norm", "safe",
                                  bounds=bounds["sentiment_score"]))


@register("minmax_eps")
def q_minmax_eps(spark, sf):
    df, bounds = R.column_bounds(reviews(spark, sf).select("helpful_votes", "order_value"))
    df = R.minmax_column(df, "helpful_votes", "helpful_norm", "eps", bounds=bounds["helpful_votes"])
    return round6(R.minmax_column(df, "order_value", "order_norm", "eps", clip_result=True,
                                  bounds=bounds["order_value"]))


@register("recency_plateau")
def q_recency_plateau(spark, sf):
    return round6(reviews(spark, sf).select(
        "days_since_purchase", C.recency_plateau("days_since_purchase").alias("recency_score")))


@register("recency_decay")
def q_recency_decay(spark, sf):
    return round6(reviews(spark, sf).select(
        "days_since_purchase", C.recency_decay("days_since_purchase").alias("recency")))


@register("severity_rating")
def q_severity_rating(spark, sf):
    return round6(reviews(spark, sf).select(
        "rating", C.severity_rating("rating").alias("severity_rating")))


@register("sentiment_to_score")
def q_sentiment_to_score(spark, sf):
    return round6(reviews(spark, sf).select(
        "sentiment", C.sentiment_to_score("sentiment").alias("sentiment_score")))


@register("issue_severity")
def q_issue_severity(spark, sf):
    return round6(reviews(spark, sf).select(
        "rating", "sentiment", C.issue_severity("rating").alias("issue_severity"),
        C.issue_severity("rating", "sentiment").alias("issue_severity_sentiment")))


@register("is_negative")
def q_is_negative(spark, sf):
    return round6(raw(spark, sf).select(
        "rating", C.is_negative(C.to_double("rating")).alias("is_negative")))


@register("encode_flags")
def q_encode_flags(spark, sf):
    return raw(spark, sf).select(
        "is_repeat_customer", "verified_purchase",
        C.flag_to_int("is_repeat_customer").alias("repeat"),
        C.flag_to_int("verified_purchase").alias("verified"))


@register("customer_importance")
def q_customer_importance(spark, sf):
    return round6(scored(spark, sf).select("ltv_norm", "order_norm", "repeat", "verified",
                                           "helpful_norm", "recency_score", "CIS"))


@register("impact_score")
def q_impact_score(spark, sf):
    return round6(scored(spark, sf).select("CIS", "issue_severity", "rating", "impact_score"))


@register("issue_category")
def q_issue_category(spark, sf):
    return rated(spark, sf).select("review_text", "issue_category")


@register("issue_category_documents")
def q_issue_category_documents(spark, sf):
    from revlens.sources.tables import read_table

    d = read_table(spark, sf, "documents", ["doc_id", "text"])
    return d.select("doc_id", C.issue_category("text").alias("issue_category"))


@register("classic_features")
def q_classic_features(spark, sf):
    df = CL.classic_features(CL.classic_preprocess(reviews(spark, sf)))
    return round6(df.select("rating", "days_since_purchase", "sentiment", "severity_rating",
                            "recency", "sentiment_score", "is_negative"))


@register("classic_scores")
def q_classic_scores(spark, sf):
    return round6(classic_reviews(spark, sf).select(
        "product", "rating", "ltv_norm", "order_norm", "helpful_norm", "repeat", "verified",
        "recency", "severity_rating", "sentiment_score", "CIS", "severity", "impact_score"))


@register("risk_category")
def q_risk_category(spark, sf):
    p = products(spark, sf)
    return round6(p.select("product", "PPS", C.risk_category("PPS").alias("risk_category")))


@register("risk_band")
def q_risk_band(spark, sf):
    p = products(spark, sf)
    return round6(p.select("product", "PPS", C.risk_band("PPS", "chart").alias("band_chart"),
                           C.risk_band("PPS", "client").alias("band_client")))


@register("severity_band")
def q_severity_band(spark, sf):
    return round6(records(spark, sf).select("name", "riskProbability", "severity"))


@register("impact_pct")
def q_impact_pct(spark, sf):
    p = products(spark, sf)
    return round6(p.select("product", "total_revenue_at_risk",
                           C.impact_pct("total_revenue_at_risk").alias("impact")))


@register("issue_split")
def q_issue_split(spark, sf):
    p = products(spark, sf).select("product", "total_reviews",
                                   C.issue_split("total_reviews").alias("issues"))
    return p.select("product", "total_reviews", "issues.*")


@register("dashboard_records")
def q_dashboard_records(spark, sf):
    return round6(flat_records(records(spark, sf)))


@register("safe_ratio")
def q_safe_ratio(spark, sf):
    p = products(spark, sf)
    return round6(p.select("product",
                           C.safe_ratio("negative_count", "total_reviews").alias("neg_share"),
                           C.safe_ratio("total_revenue_at_risk", "negative_count")
                           .alias("revenue_per_negative")))


@register("nested_get")
def q_nested_get(spark, sf):
    from revlens.sources.tables import read_table

    e = read_table(spark, sf, "events", ["event_id", "props"])
    return e.select("event_id", C.nested_get("props", "k", "0").alias("k"),
                    C.nested_get("props", "a.b", "none").alias("a_b"))


@register("format_ranking")
def q_format_ranking(spark, sf):
    return D.format_ranking(quad(spark, sf))


# ---- §2.2 schema normalisation, cleaning, data quality ------------------------------
from revlens.operators import gate as G  # noqa: E402
from revlens.operators import quality as Q  # noqa: E402
from revlens.sources.tables import read_table, spike_review_view  # noqa: E402


def raw_named(spark, sf):
    """Raw source with the canonical product / LTV names (for operators that
    expect them)."""
    return raw(spark, sf).withColumnRenamed("product_name", "product") \
        .withColumnRenamed("ltv", "customer_ltv")


def raw_numeric(spark, sf):
    """Raw source with the rating coerced (unparsable -> null)."""
    return raw(spark, sf).withColumn("rating", C.to_double("rating"))


@register("normalize_reviews")
def q_normalize_reviews(spark, sf):
    return round6(R.normalize_reviews(raw(spark, sf)))


@register("normalize_reviews_service")
def q_normalize_reviews_service(spark, sf):
    return round6(R.normalize_reviews_service(raw(spark, sf)))


@register("fetch_column_repair")
def q_fetch_column_repair(spark, sf):
    return round6(R.fetch_column_repair(raw_named(spark, sf)))


@register("enforce_schema")
def q_enforce_schema(spark, sf):
    return round6(Q.enforce_schema(raw(spark, sf)))


@register("fill_missing")
def q_fill_missing(spark, sf):
    return round6(Q.fill_missing(raw_numeric(spark, sf)))


@register("final_null_sweep")
def q_final_null_sweep(spark, sf):
    return round6(Q.final_null_sweep(raw_numeric(spark, sf)))


@register("numeric_null_to_zero")
def q_numeric_null_to_zero(spark, sf):
    return round6(R.numeric_null_to_zero(raw_numeric(spark, sf)))


@register("clip_ranges")
def q_clip_ranges(spark, sf):
    df = raw_numeric(spark, sf).select(
        (F.col("rating") * 1.25 - 0.5).alias("rating"),
        (F.col("days_since_purchase") / 100.0).alias("sentiment_score"))
    return round6(Q.clip_ranges(df))


@register("null_profile")
def q_null_profile(spark, sf):
    return round6(Q.null_profile(raw(spark, sf)))


@register("sanity_checks")
def q_sanity_checks(spark, sf):
    return Q.sanity_checks(raw(spark, sf))


@register("robust_preprocess")
def q_robust_preprocess(spark, sf):
    return round6(Q.robust_preprocess(raw(spark, sf)))


@register("robust_pipeline")
def q_robust_pipeline(spark, sf):
    """Through its gate, which raises on the way if anything critical is left."""
    return round6(Q.robust_pipeline_checked(raw(spark, sf)).good)


def _gated(spark, sf):
    df = raw_named(spark, sf).select("product", "rating", "review_text", "customer_ltv", "order_value",
                                     "days_since_purchase", "helpful_votes")
    return G.check_rows(df, G.input_constraints(df))


@register("accepted_reviews")
def q_accepted_reviews(spark, sf):
    return round6(_gated(spark, sf).good)


@register("quarantined_reviews")
def q_quarantined_reviews(spark, sf):
    bad = _gated(spark, sf).quarantine
    return round6(bad.withColumn("violated", F.array_join("violated", ",")))


@register("gate_report")
def q_gate_report(spark, sf):
    return _gated(spark, sf).report()


@register("prepare_reviews")
def q_prepare_reviews(spark, sf):
    return round6(R.prepare_reviews(norm(spark, sf)))


@register("classic_preprocess")
def q_classic_preprocess(spark, sf):
    return round6(CL.classic_preprocess(reviews(spark, sf)))


@register("ingest_summary")
def q_ingest_summary(spark, sf):
    landed = SF.land_pages(spark, _landed_pages(spark, sf))
    return round6(Q.ingest_summary(R.fetch_column_repair(landed.reviews), landed.failed()))


@register("quality_overview")
def q_quality_overview(spark, sf):
    return round6(Q.quality_overview(rated(spark, sf)))


def _check_rows(spark, name, outcomes) -> DataFrame:
    """One row per input: which check, which input, passed, message, rows of the input."""
    out = None
    for label, df, ok, message in outcomes:
        row = df.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("check"), F.lit(label).alias("input"), F.lit(ok).alias("ok"),
            F.lit(message).alias("message"), "n")
        out = row if out is None else out.union(row)
    return out


def _outcome(check, *args):
    try:
        check(*args)
    except G.DataError as e:
        return False, str(e)
    return True, ""


@register("check_required_columns")
def q_check_required_columns(spark, sf):
    good = raw(spark, sf)
    bad = good.drop("rating")
    return _check_rows(spark, "required_columns", [
        (label, df, *R.check_required_columns(df)) for label, df in (("raw", good), ("no rating", bad))])


@register("assert_columns")
def q_assert_columns(spark, sf):
    df = reviews(spark, sf)
    return _check_rows(spark, "columns", [
        (label, df, *_outcome(Q.assert_columns, df, need, "reviews"))
        for label, need in (("present", ["product", "rating"]), ("absent", ["product", "no_such"]))])


@register("assert_not_empty")
def q_assert_not_empty(spark, sf):
    df = reviews(spark, sf)
    none = df.where("rating > 5")
    return _check_rows(spark, "not_empty", [
        (label, x, *_outcome(Q.assert_not_empty, x, "reviews")) for label, x in (("all", df), ("none", none))])


@register("schema_report")
def q_schema_report(spark, sf):
    return Q.schema_report(raw(spark, sf))


@register("fill_report")
def q_fill_report(spark, sf):
    return Q.fill_report(raw_numeric(spark, sf))


@register("preprocess_report")
def q_preprocess_report(spark, sf):
    return Q.preprocess_report(raw(spark, sf))


@register("robustness_report")
def q_robustness_report(spark, sf):
    return Q.robustness_report(raw(spark, sf))


@register("validate_output")
def q_validate_output(spark, sf):
    return Q.validate_output(Q.robust_pipeline(raw(spark, sf)))


# ---- §2.4 filters ---------------------------------------------------------------------
PRODUCT_PICK = ["red plate Brand#8", "hot rod Brand#16", "blue widget Brand#15"]


@register("filter_products")
def q_filter_products(spark, sf):
    return round6(D.filter_products(scored(spark, sf), PRODUCT_PICK)
                  .select("product", "rating", "impact_score"))


@register("filter_dates")
def q_filter_dates(spark, sf):
    return round6(D.filter_dates(rated(spark, sf), "1996-01-01", "1996-12-31")
                  .select("product", "review_date", "rating"))


@register("filter_severity")
def q_filter_severity(spark, sf):
    return round6(D.filter_severity(rated(spark, sf), 0.5).select("product", "issue_severity"))


@register("apply_filters")
def q_apply_filters(spark, sf):
    df = D.apply_filters(scored(spark, sf), None, ("1995-06-01", "1997-06-30"), 0.45)
    return round6(df.select("product", "review_date", "issue_severity", "impact_score"))


@register("filter_records")
def q_filter_records(spark, sf):
    df = D.filter_records(records(spark, sf), None, "2024-01-01", "2024-12-31", "All", 0.5)
    return round6(flat_records(df))


@register("search_products")
def q_search_products(spark, sf):
    return round6(D.search_products(records(spark, sf), "brand#1").select("name", "finalScore"))


@register("product_lookup")
def q_product_lookup(spark, sf):
    return round6(D.product_lookup(quad(spark, sf), "RED PLATE BRAND#8"))


@register("risky_reviews")
def q_risky_reviews(spark, sf):
    return round6(D.risky_reviews(rated(spark, sf)).select("product", "rating", "customer_ltv"))


@register("complaint_reviews")
def q_complaint_reviews(spark, sf):
    return round6(D.complaint_reviews(rated(spark, sf))
                  .select("product", "rating", "issue_category"))


@register("drop_blank_products")
def q_drop_blank_products(spark, sf):
    return D.drop_blank_products(raw_named(spark, sf)).select("product", "rating")


# ---- §2.5 joins / §2.7 windows ------------------------------------------------------------
@register("reviews_of_products")
def q_reviews_of_products(spark, sf):
    s = scored(spark, sf)
    fire = quad(spark, sf, s).filter(F.col("quadrant") == "The Fire-Fight")
    return round6(D.reviews_of_products(s, fire)
                  .select("product", "rating", "impact_score"))


@register("review_count_window")
def q_review_count_window(spark, sf):
    return round6(D.review_count_window(scored(spark, sf))
                  .select("product", "impact_score", "review_count"))


@register("top3_flag")
def q_top3_flag(spark, sf):
    return round6(D.top3_flag(quad(spark, sf)).select("product", "total_revenue_at_risk",
                                                      "is_top3"))


# ---- §2.6 aggregations ------------------------------------------------------------------
@register("revenue_at_risk")
def q_revenue_at_risk(spark, sf):
    return round6(D.revenue_at_risk(rated(spark, sf)))


@register("summary_stats")
def q_summary_stats(spark, sf):
    s = scored(spark, sf)
    return round6(D.summary_stats(s, quad(spark, sf, s)))


@register("kpis")
def q_kpis(spark, sf):
    s = scored(spark, sf)
    return round6(D.kpis(s, quad(spark, sf, s)))


@register("kpis_weighted")
def q_kpis_weighted(spark, sf):
    return round6(D.kpis_weighted(records(spark, sf)))


@register("issue_breakdown")
def q_issue_breakdown(spark, sf):
    return D.issue_breakdown(rated(spark, sf))


@register("risk_distribution")
def q_risk_distribution(spark, sf):
    return round6(D.risk_distribution(records(spark, sf), "riskProbability"))


@register("severity_distribution")
def q_severity_distribution(spark, sf):
    return round6(D.severity_distribution(records(spark, sf)))


@register("distinct_products")
def q_distinct_products(spark, sf):
    return D.distinct_products(raw_named(spark, sf))


@register("date_bounds")
def q_date_bounds(spark, sf):
    return D.date_bounds(rated(spark, sf))


@register("date_bounds_events")
def q_date_bounds_events(spark, sf):
    ev = read_table(spark, sf, "events", ["ts"]).withColumnRenamed("ts", "review_date")
    return D.date_bounds(ev)


@register("quantile_thresholds")
def q_quantile_thresholds(spark, sf):
    from revlens.functions.stats import quantiles

    return round6(quantiles(quad(spark, sf), [
        ("p75_revenue", "total_revenue_at_risk", 0.75), ("p75_impact", "total_impact", 0.75),
        ("p75_negative", "negative_ratio", 0.75), ("p75_score", "final_score", 0.75),
        ("p25_rating", "avg_rating", 0.25)]))


@register("issue_totals")
def q_issue_totals(spark, sf):
    return D.issue_totals(records(spark, sf))


def spike_scored(spark, sf):
    return R.score_reviews(R.normalize_reviews(spike_review_view(spark, sf)))


@register("spike_stats")
def q_spike_stats(spark, sf):
    return round6(P.spike_stats(spike_scored(spark, sf)))


@register("score_validation")
def q_score_validation(spark, sf):
    return round6(CL.score_validation(classic_reviews(spark, sf)))


# ---- §2.8 sorts, limits, top-k ---------------------------------------------------------
@register("rank_products")
def q_rank_products(spark, sf):
    return round6(P.rank_products(quad(spark, sf)).select("product", "final_score"))


@register("top_revenue")
def q_top_revenue(spark, sf):
    return round6(D.top_n(quad(spark, sf), "total_revenue_at_risk", 5)
                  .select("product", "total_revenue_at_risk"))


@register("top_for_insight")
def q_top_for_insight(spark, sf):
    from revlens.operators.insights import top_for_insight

    return round6(top_for_insight(quad(spark, sf), 5).select("product", "final_score"))


@register("top_risk_cards")
def q_top_risk_cards(spark, sf):
    return round6(D.top_n(records(spark, sf), "riskProbability", 5, "name")
                  .select("name", "riskProbability", "revenueAtRisk", "frequency"))


@register("top_product")
def q_top_product(spark, sf):
    return D.top_product(quad(spark, sf))


@register("sort_records")
def q_sort_records(spark, sf):
    return round6(D.sort_records(records(spark, sf), "revenue", "desc")
                  .select("name", "revenueAtRisk", "finalScore"))


@register("revenue_ranking")
def q_revenue_ranking(spark, sf):
    return round6(D.revenue_ranking(quad(spark, sf)))


@register("top_issue")
def q_top_issue(spark, sf):
    return D.top_issue(records(spark, sf))


@register("top_two_issues")
def q_top_two_issues(spark, sf):
    return D.top_two_issues(records(spark, sf))


@register("preview")
def q_preview(spark, sf):
    return round6(D.preview(scored(spark, sf), 20, ["impact_score", "product", "rating",
                                                     "review_text", "issue_severity",
                                                     "is_negative"]))


# ---- §2.9 product-level scoring and decisions -------------------------------------------
def classic_products(spark, sf, spike: bool = False):
    if spike:
        src = spike_review_view(spark, sf)
        rev = CL.classic_scores(CL.classic_features(CL.classic_preprocess(src)))
    else:
        rev = classic_reviews(spark, sf)
    return P.classic_product_metrics(rev)


@register("product_priority")
def q_product_priority(spark, sf):
    return round6(P.product_priority(P.product_metrics(scored(spark, sf)))
                  .select("product", "PPS"))


@register("final_score")
def q_final_score(spark, sf):
    return round6(products(spark, sf).select("product", "total_impact", "PPS", "final_score"))


@register("classic_product_metrics")
def q_classic_product_metrics(spark, sf):
    return round6(classic_products(spark, sf))


@register("zero_impact_gate")
def q_zero_impact_gate(spark, sf):
    return round6(classic_products(spark, sf).filter(F.col("total_impact") == 0)
                  .select("product", "total_impact", "final_score"))


@register("spike_boost")
def q_spike_boost(spark, sf):
    return round6(classic_products(spark, sf, spike=True)
                  .select("product", "total_reviews", "total_impact", "PPS", "final_score"))


@register("quadrant_priority")
def q_quadrant_priority(spark, sf):
    return quad(spark, sf).select("product", "quadrant", "priority")


@register("make_decisions")
def q_make_decisions(spark, sf):
    return round6(P.make_decisions(classic_products(spark, sf)))


@register("quadrant_chart_data")
def q_quadrant_chart_data(spark, sf):
    return round6(P.quadrant_chart_data(quad(spark, sf)))


# ---- §2.10 machine learning ---------------------------------------------------------------
from revlens.operators import insights as I  # noqa: E402
from revlens.operators import risk as RK  # noqa: E402


@register("ml_features")
def q_ml_features(spark, sf):
    df, feats = RK.ml_features(quad(spark, sf))
    return round6(df.select("product", "negative_reviews", *feats))


@register("risk_labels")
def q_risk_labels(spark, sf):
    df, _ = RK.ml_features(quad(spark, sf))
    return round6(RK.risk_labels(df).select("product", "final_score", "risk_threshold",
                                            "high_risk"))


def _fitted(spark, sf):
    df, feats = RK.ml_features(quad(spark, sf))
    df = written(df, "features")
    return df, RK.train_risk_model(df, feats)


@register("train_risk_model")
def q_train_risk_model(spark, sf):
    """The fitted model itself: scaling and coefficient of every feature, and the intercept."""
    _, model = _fitted(spark, sf)
    return round6(RK.model_table(model, spark))


@register("feature_importance")
def q_feature_importance(spark, sf):
    _, model = _fitted(spark, sf)
    return round6(RK.feature_importance(model, spark))


@register("training_stats")
def q_training_stats(spark, sf):
    df, model = _fitted(spark, sf)
    return round6(RK.training_stats(model, df))


@register("predict_risk")
def q_predict_risk(spark, sf):
    df, model = _fitted(spark, sf)
    return round6(RK.predict_risk(model, df).select("product", "risk_probability",
                                                     "high_risk_predicted", "risk_category"))


def ml_products(spark, sf, of: DataFrame | None = None):
    out, _ = RK.apply_ml_predictions(quad(spark, sf, of))
    return out


@register("apply_ml_predictions")
def q_apply_ml_predictions(spark, sf):
    return round6(ml_products(spark, sf))


@register("join_predictions")
def q_join_predictions(spark, sf):
    q = quad(spark, sf)
    df, feats = RK.ml_features(q)
    df = written(df, "features")
    pred = RK.predict_risk(RK.train_risk_model(df, feats), df).select(
        "product", "risk_probability", "risk_category", "high_risk_predicted")
    return round6(D.join_predictions(q, pred))


@register("restore_predictions")
def q_restore_predictions(spark, sf):
    """Re-aggregated filtered products LEFT JOIN the earlier predictions."""
    s = scored(spark, sf)
    ml = ml_products(spark, sf, s)
    filt = D.apply_filters(s, None, ("1995-06-01", "1998-12-31"), 0.0)
    again = P.classify_quadrants(P.product_scores(filt))
    pred = ml.select("product", "risk_probability", "risk_category", "high_risk_predicted")
    return round6(D.join_predictions(again, pred))


@register("risk_summary")
def q_risk_summary(spark, sf):
    return round6(D.risk_summary(ml_products(spark, sf)))


@register("kpis_enhanced")
def q_kpis_enhanced(spark, sf):
    s = scored(spark, sf)
    return round6(D.kpis_enhanced(s, ml_products(spark, sf, s)))


@register("ml_insight_kpis")
def q_ml_insight_kpis(spark, sf):
    return round6(D.ml_insight_kpis(ml_products(spark, sf)))


@register("hidden_risks")
def q_hidden_risks(spark, sf):
    return round6(D.hidden_risks(ml_products(spark, sf)).select(
        "product", "quadrant", "risk_probability"))


@register("filter_risk")
def q_filter_risk(spark, sf):
    return round6(D.filter_risk(ml_products(spark, sf), 0.5).select("product",
                                                                      "risk_probability"))


@register("rating_vs_risk_data")
def q_rating_vs_risk_data(spark, sf):
    return round6(D.rating_vs_risk_data(ml_products(spark, sf)))


# The consumers again over given probabilities (the products' PPS), which SQL can check.
def given_products(spark, sf, of: DataFrame | None = None):
    q = quad(spark, sf, of)
    pred = q.select("product", F.col("PPS").alias("risk_probability"),
                    C.risk_category("PPS").alias("risk_category"),
                    (F.col("PPS") > 0.5).cast("int").alias("high_risk_predicted"))
    return D.join_predictions(q, pred)


@register("join_predictions_given")
def q_join_predictions_given(spark, sf):
    return round6(given_products(spark, sf))


@register("risk_summary_given")
def q_risk_summary_given(spark, sf):
    return round6(D.risk_summary(given_products(spark, sf)))


@register("kpis_enhanced_given")
def q_kpis_enhanced_given(spark, sf):
    s = scored(spark, sf)
    return round6(D.kpis_enhanced(s, given_products(spark, sf, s)))


@register("ml_insight_kpis_given")
def q_ml_insight_kpis_given(spark, sf):
    return round6(D.ml_insight_kpis(given_products(spark, sf)))


@register("hidden_risks_given")
def q_hidden_risks_given(spark, sf):
    return round6(D.hidden_risks(given_products(spark, sf), 0.5).select(
        "product", "quadrant", "risk_probability"))


@register("filter_risk_given")
def q_filter_risk_given(spark, sf):
    return round6(D.filter_risk(given_products(spark, sf), 0.5).select("product", "risk_probability"))


@register("rating_vs_risk_data_given")
def q_rating_vs_risk_data_given(spark, sf):
    return round6(D.rating_vs_risk_data(given_products(spark, sf)))


# ---- §2.11 insight columns -----------------------------------------------------------------
def replies(df: DataFrame) -> DataFrame:
    """Model replies derived from the products (stand-in for the remote reply
    table): a usable JSON answer for products with an even review count, an
    unparsable one otherwise."""
    good = F.to_json(F.struct(F.concat(F.lit("  Watch "), F.col("product"), F.lit("  "))
                              .alias("summary"), F.col("quadrant").alias("driver"),
                              F.col("action").alias("recommendation")))
    reply = F.when(F.col("total_reviews") % 2 == 0, good).otherwise(F.lit("not json"))
    return df.select("product", reply.alias("reply"),
                     (F.col("llm_payload") if "llm_payload" in df.columns
                      else F.lit(None).cast("string")).alias("payload"))


INSIGHT_OUT = ["product", "llm_summary", "llm_driver", "llm_recommendation", "llm_source"]


@register("insight_payload")
def q_insight_payload(spark, sf):
    return I.insight_payload(quad(spark, sf)).select("product", "llm_payload")


@register("rule_insight")
def q_rule_insight(spark, sf):
    return I.rule_insight(quad(spark, sf)).select(*INSIGHT_OUT)


@register("enrich_products")
def q_enrich_products(spark, sf):
    return I.enrich_products(quad(spark, sf), 5).select(*INSIGHT_OUT)


@register("parse_insight_reply")
def q_parse_insight_reply(spark, sf):
    return I.parse_insight_reply(replies(quad(spark, sf))).select(
        "product", "llm_summary", "llm_driver", "llm_recommendation")


@register("merge_insights")
def q_merge_insights(spark, sf):
    q = I.rule_insight(quad(spark, sf))
    return I.merge_insights(q, replies(q)).select(*INSIGHT_OUT)


@register("insight_view")
def q_insight_view(spark, sf):
    return I.insight_view(I.enrich_products(quad(spark, sf), 5), 5)


@register("product_card_text")
def q_product_card_text(spark, sf):
    return I.product_card_text(records(spark, sf))


@register("portfolio_summary")
def q_portfolio_summary(spark, sf):
    return I.portfolio_summary(records(spark, sf))


@register("portfolio_prompt")
def q_portfolio_prompt(spark, sf):
    return I.portfolio_prompt(records(spark, sf))


# ---- §2.12 pipelines -------------------------------------------------------------------------
from revlens.plans import pipeline as PL  # noqa: E402


@register("run_service")
def q_run_service(spark, sf):
    _, prods = PL.run_service(raw(spark, sf))
    return round6(prods)


@register("run_classic")
def q_run_classic(spark, sf):
    return round6(PL.run_classic(reviews(spark, sf)))


@register("filtered_dashboard")
def q_filtered_dashboard(spark, sf):
    return round6(PL.filtered_dashboard(reviews(spark, sf), date_range=("1995-06-01", "1998-12-31"),
                                        severity_threshold=0.4, risk_threshold=0.3))


# ---- §2.1 sources and sinks (round trips through the shared scratch folder) -------------
from revlens.session import scratch_path  # noqa: E402
from revlens.sources import files as SF  # noqa: E402


def _landed_pages(spark, sf) -> str:
    """Reviews landed as paged envelopes: one page per order (``ok + 1``); an order
    without line items leaves its page missing."""
    from revlens.sources.tables import _base, _review_columns

    cols = _review_columns()
    rows = _base(spark, sf).select((F.col("ok") + 1).cast("int").alias("page"),
                                   *[c.alias(n) for n, c in cols.items()])
    path = scratch_path(spark, "pages")
    SF.write_review_pages(rows.withColumn("review_date", F.col("review_date").cast("string")),
                          path)
    return path


NORM_STABLE = ["product", "rating", "review_text", "sentiment", "customer_ltv", "order_value",
               "days_since_purchase", "helpful_votes", "is_repeat_customer", "verified_purchase",
               "sentiment_score"]


@register("read_reviews_csv")
def q_read_reviews_csv(spark, sf):
    path = scratch_path(spark, "csv")
    SF.write_reviews_csv(reviews(spark, sf), path)
    return round6(R.normalize_reviews(SF.read_reviews_csv(spark, path)).select(*NORM_STABLE))


@register("read_reviews_json")
def q_read_reviews_json(spark, sf):
    from revlens.sources.tables import _base, _review_columns

    cols = _review_columns()
    rows = _base(spark, sf).select(F.col("ok").alias("__doc"),
                                   *[c.alias(n) for n, c in cols.items()])
    docs = rows.groupBy("__doc").agg(F.collect_list(F.struct(*cols.keys())).alias("records"))
    path = scratch_path(spark, "json")
    docs.select("records").write.mode("overwrite").options(**SF.LANDED).json(path)
    return round6(R.normalize_reviews(SF.read_reviews_json(spark, path, multi_line=False))
                  .select(*NORM_STABLE))


@register("read_review_pages")
def q_read_review_pages(spark, sf):
    path = _landed_pages(spark, sf)
    df = R.fetch_column_repair(SF.read_review_pages(spark, path, max_pages=None))
    return round6(df.select("page", "product", "rating", "review_text", "customer_ltv",
                            "order_value", "helpful_votes"))


@register("page_gap_report")
def q_page_gap_report(spark, sf):
    path = _landed_pages(spark, sf)
    return SF.page_gap_report(spark, SF.page_envelopes(spark, path))


@register("read_review_pages_limited")
def q_read_review_pages_limited(spark, sf):
    path = _landed_pages(spark, sf)
    df = R.fetch_column_repair(SF.read_review_pages(spark, path, max_pages=100))
    return round6(df.select("page", "product", "rating", "customer_ltv"))


@register("read_reviews_json_mixed")
def q_read_reviews_json_mixed(spark, sf):
    """Documents of every shape in one folder: by order number data, records, flat rows, both."""
    from revlens.sources.tables import _base, _review_columns

    cols = _review_columns()
    rows = _base(spark, sf).select("ok", *[c.cast("string").alias(n) for n, c in cols.items()])
    shaped = rows.groupBy("ok").agg(F.collect_list(F.struct(*cols)).alias("d"))
    path = scratch_path(spark, "json-mixed")
    kind = F.col("ok") % 3
    lines = (F.when(kind == 0, F.array(F.to_json(F.struct(F.col("d").alias("data")))))
             .when(kind < 2, F.array(F.to_json(F.struct(F.col("d").alias("records")))))
             .otherwise(F.transform("d", lambda r: F.to_json(r))))
    shaped.select(F.explode(lines).alias("value")).write.options(**SF.LANDED).text(path)
    return round6(R.normalize_reviews(SF.read_reviews_json(spark, path)).select(*NORM_STABLE))


@register("load_reviews")
def q_load_reviews(spark, sf):
    path = _landed_pages(spark, sf)
    return round6(SF.load_reviews(spark, "pages", path, max_pages=None).select(*NORM_STABLE))


@register("write_dashboard_json")
def q_write_dashboard_json(spark, sf):
    recs = records(spark, sf)
    path = scratch_path(spark, "dashboard")
    SF.write_dashboard_json(recs, path)
    return round6(flat_records(spark.read.schema(recs.schema).json(path)))


# ---- streaming: incremental page ingestion ------------------------------------------------
@register("stream_revenue_at_risk")
def q_stream_revenue_at_risk(spark, sf):
    """Landed pages -> streaming per-product running totals -> table -> batch read."""
    from revlens.streaming import pages as ST

    path = _landed_pages(spark, sf)
    sink, ckpt = scratch_path(spark, "stream-sink"), scratch_path(spark, "stream-ckpt")
    ST.run_available(ST.running_revenue_at_risk(ST.page_stream(spark, path)), sink, ckpt)
    return round6(ST.read_sink(spark, sink))


@register("stream_land_pages")
def q_stream_land_pages(spark, sf):
    from revlens.streaming import pages as ST

    path = _landed_pages(spark, sf)
    table, ckpt = scratch_path(spark, "landed"), scratch_path(spark, "landed-ckpt")
    ST.land_pages(spark, path, table, ckpt)
    return round6(spark.read.parquet(table).select("page", "product", "rating", "customer_ltv"))
