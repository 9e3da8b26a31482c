import math

import pytest
from pyspark.sql import functions as F

from revlens.functions import columns as C
from revlens.operators import reviews as R
from tests.fixtures import sample_a, upload

TOL = 1e-5


def by_product(rows, key="product"):
    return {r[key]: r for r in rows}


def test_recency_plateau_golden(spark):
    df = spark.createDataFrame([(5.0,), (10.0,), (30.0,), (60.0,), (None,)], "d double")
    got = [r.r for r in df.select(C.recency_plateau("d").alias("r")).collect()]
    assert got[:4] == pytest.approx([1.0, 1.0, 0.513417, 0.188876], abs=TOL)
    assert got[4] is None


def test_sample_a_reviews_golden(spark):
    rows = by_product(R.score_reviews(R.normalize_reviews_service(sample_a(spark))).collect())
    want = {
        "Atlas Desk": (.846482, .530, .934115, .495081, "Quality"),
        "Pulse Earbuds": (.716531, .485, .575976, 0.0, "Other"),
        "North Mug": (.513417, .410, .327013, 0.0, "Other"),
        "Harbor Lamp": (1.0, .440, .667887, 0.0, "Quality"),
        "Summit Bottle": (.311403, .365, .476019, 0.0, "Other"),
    }
    for p, (rec, sev, cis, imp, cat) in want.items():
        r = rows[p]
        assert r.recency_score == pytest.approx(rec, abs=TOL)
        assert r.issue_severity == pytest.approx(sev, abs=TOL)
        assert r.CIS == pytest.approx(cis, abs=TOL)
        assert r.impact_score == pytest.approx(imp, abs=TOL)
        assert r.issue_category == cat


def test_upload_dashboard_profile_reviews(spark):
    rows = R.score_reviews(R.normalize_reviews(upload(spark))).collect()
    cis = [.45, .45, .353418, .353418, .15, .15, .295624, .295624, .228907, .228907]
    imp = [.25875, .306, 0, 0, 0, 0, .183287, .19659, 0, 0]
    neg = [0, 1, 0, 0, 0, 0, 0, 1, 0, 0]
    cat = ["Quality", "Other", "Quality", "Other", "Other", "Pricing", "Other", "Quality",
           "Other", "Other"]
    key = {(r.product, r.rating): r for r in rows}
    src = upload(spark).collect()
    for i, s in enumerate(src):
        r = key[(s.product_name, s.rating)]
        assert r.CIS == pytest.approx(cis[i], abs=TOL)
        assert r.impact_score == pytest.approx(imp[i], abs=TOL)
        assert r.is_negative == neg[i]
        assert r.issue_category == cat[i]


def test_clip_keeps_null_and_minmax_variants(spark):
    df = spark.createDataFrame([(-1.0,), (0.5,), (2.0,), (None,)], "x double")
    got = [r.c for r in df.select(C.clip01("x").alias("c")).collect()]
    assert got == [0.0, 0.5, 1.0, None]
    const = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert {r.n for r in R.minmax_column(const, "x", "n", "const0").collect()} == {0.0}
    assert {r.n for r in R.minmax_column(const, "x", "n", "safe").collect()} == {0.5}


def test_issue_category_priority_and_substrings(spark):
    texts = [("Late and broken",), ("Perfect for coffee",), ("chocolate plate",),
             ("support was rude",), (None,), ("QUALITY",)]
    df = spark.createDataFrame(texts, "t string")
    got = [r.c for r in df.select(C.issue_category("t").alias("c")).collect()]
    assert got == ["Delivery", "Pricing", "Delivery", "Service", "Other", "Quality"]


def test_log_scale_negative_is_null(spark):
    df = spark.createDataFrame([(-2.0,), (-1.0,), (0.0,), (math.e - 1,)], "x double")
    got = [r.l for r in df.select(C.log_scale("x").alias("l")).collect()]
    assert got[0] is None and got[1] is None and got[2] == 0.0
    assert got[3] == pytest.approx(1.0)


def test_sentiment_maps(spark):
    df = spark.createDataFrame([("positive",), ("negative",), ("neutral",), ("mixed",), (None,)],
                               "s string")
    got = [(r.a, r.b) for r in df.select(C.sentiment_to_score("s").alias("a"),
                                         C.issue_severity(F.lit(5.0), "s").alias("b")).collect()]
    assert [g[0] for g in got] == [1.0, 0.0, 0.5, 0.5, 0.5]
    assert [g[1] for g in got] == pytest.approx([0.0, 0.4, 0.2, 0.2, 0.2])
