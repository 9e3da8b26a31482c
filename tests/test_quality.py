from pyspark.sql import functions as F

from revlens.operators import quality as Q

SCHEMA = "rating string, helpful_votes double, order_value double, product string"


def test_enforce_schema_defaults_and_truncation(spark):
    df = spark.createDataFrame([("bad", 2.9, None, "a"), ("4.5", None, 10.0, None)], SCHEMA)
    out = {r.product: r for r in Q.enforce_schema(df).collect()}
    assert out["a"].rating == 3.0 and out["a"].helpful_votes == 2 and out["a"].order_value == 0.0
    assert out[None].rating == 4.5 and out[None].helpful_votes == 0
    assert out["a"].sentiment_score == 0.5 and out["a"].days_since_purchase == 30
    assert out["a"].detected_issues == "unknown" and out["a"].repeat == 0


def test_null_profile_and_sanity(spark):
    df = spark.createDataFrame([(None, 1.0, 2.0, "a"), ("3", None, float("nan"), None)], SCHEMA)
    prof = {r.column: r for r in Q.null_profile(df).collect()}
    assert prof["rating"].null_count == 1 and prof["rating"].critical
    assert prof["order_value"].null_count == 1 and prof["order_value"].null_pct == 50.0
    issues = Q.sanity_checks(df).collect()
    checks = {(r.check, r.column) for r in issues}
    assert ("missing_column", "customer_ltv") in checks
    assert ("critical_nan", "rating") in checks
    assert ("dtype", "rating") in checks
    assert not Q.is_valid(Q.sanity_checks(df))


def test_robust_preprocess_constant_column_is_half(spark):
    df = spark.createDataFrame([("2", 1.0, 5.0, "a"), ("7", 3.0, 5.0, "b")], SCHEMA)
    out = {r.product: r for r in Q.robust_preprocess(df).collect()}
    assert out["a"].ltv_norm == 0.5          # LTV missing -> constant -> 0.5
    assert out["a"].order_norm == 0.5        # constant order value
    assert out["b"].helpful_norm == 1.0
    assert out["b"].rating == 5.0            # clipped to [1, 5]
    rep = Q.sanity_checks(Q.robust_pipeline(df))
    assert Q.is_valid(rep)


def test_fill_report_counts(spark):
    df = spark.createDataFrame([(None, None, 1.0, "a"), ("1", 2.0, None, None)], SCHEMA)
    rep = {r.column: r.n for r in Q.fill_report(df.withColumn(
        "rating", F.col("rating").cast("double"))).collect()}
    assert rep["rating"] == 1 and rep["helpful_votes"] == 1 and rep["__before"] == 4
    assert rep["__after"] == 1
