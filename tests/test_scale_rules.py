"""No caps, no switches by size or shape, and no work for statistics that are not used."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from revlens.functions import columns as C
from revlens.functions.stats import quantiles
from revlens.operators import quality as Q
from revlens.operators import risk as RK
from revlens.plans import queries as Qs
from revlens.sources import files as SF
from tests.conftest import SF0001


def _lines(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as fh:
        fh.write("\n".join(lines) + "\n")
    return folder


def test_quantiles_above_the_accuracy(spark):
    """150,000 values with heavy ties and a long tail, on the one path there is."""
    rng = np.random.default_rng(11)
    vals = np.concatenate([np.zeros(60_000), rng.integers(0, 9, 40_000) / 4.0, np.exp(rng.normal(0, 6, 50_000))])
    df = spark.createDataFrame([(float(v),) for v in vals], "x double").repartition(5)
    qs = [0.0, 0.1, 0.4, 0.5, 0.75, 0.9999, 1.0]
    row = quantiles(df, [(f"q{i}", "x", q) for i, q in enumerate(qs)]).first()
    for i, q in enumerate(qs):
        assert row[f"q{i}"] == pytest.approx(float(np.quantile(vals, q)), rel=1e-12), q


def test_all_pages_and_unnumbered_ones(spark, tmpdir_path):
    d = _lines(tmpdir_path + "/p", "land.json", [
        json.dumps({"data": [{"product": "A", "rating": p}], "metadata": {"page": p}}) for p in range(1, 121)]
        + [json.dumps({"data": [{"product": "B", "rating": 1}], "metadata": {}})])
    assert SF.read_review_pages(spark, d).count() == 121
    limited = SF.read_review_pages(spark, d, max_pages=100)
    assert limited.count() == 101 and limited.where("page is null").count() == 1
    gaps = SF.page_gap_report(spark, SF.page_envelopes(spark, d).where("page % 40 <> 0 or page is null"))
    assert sorted(r.page for r in gaps.collect()) == [40, 80]


def test_each_document_by_its_own_shape(spark, tmpdir_path):
    row = {"rating": 1}
    d = _lines(tmpdir_path + "/m", "mixed.json", [
        json.dumps({"data": [{"product": "a", **row}]}), json.dumps({"records": [{"product": "b", **row}]}),
        json.dumps({"product": "c", **row}), json.dumps({"product": "d", "meta": {"x": 1}}),
        json.dumps([{"product": "e", **row}]), "{broken"])
    got = {r.product for r in SF.read_reviews_json(spark, d).collect()}
    assert got - {None} == {"a", "b", "c", "d", "e"}
    assert tuple(SF.malformed_documents(spark, d).first()) == (6, 1)


def test_csv_is_split(spark, tmpdir_path):
    d = _lines(tmpdir_path + "/c", "big.csv", ["product,rating"] + [f"p{k},{k % 5}" for k in range(60_000)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        df = SF.read_reviews_csv(spark, d)
        assert df.select(F.spark_partition_id().alias("p")).distinct().count() > 1
        assert df.count() == 60_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_dirty_flags_do_not_end_the_job(spark):
    df = spark.createDataFrame([("true",), ("0",), ("2",), ("maybe",), (None,), ("no",)], "f string")
    got = [tuple(r) for r in df.select(C.flag_to_int("f"), C.bad_flag("f")).collect()]
    assert got == [(1, False), (0, False), (2, False), (0, True), (0, False), (0, False)]


@pytest.mark.parametrize("name", ["issue_breakdown", "date_bounds", "risky_reviews", "complaint_reviews",
                                  "filter_severity", "issue_category", "revenue_at_risk"])
def test_unused_statistics_are_not_computed(spark, name):
    plan = Qs.QUERIES[name](spark, SF0001)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= 4 and "Subquery" not in plan


def test_output_gate(spark):
    out = Q.robust_pipeline(Qs.raw(spark, SF0001))
    assert all(r.ok for r in Q.validate_output(out).collect())
    bad = {r.check: r.ok for r in Q.validate_output(out.drop("verified").withColumn(
        "rating", F.when(F.col("rating") > 2, F.col("rating")))).collect()}
    assert bad == {"non_empty": True, "required_columns_present": False, "no_critical_nan": False,
                   "correct_dtypes": True, "valid": False}
    assert Q.robust_pipeline_checked(Qs.raw(spark, SF0001)).columns == out.columns
    with pytest.raises(Q.DataError):
        Q.robust_pipeline_checked(Qs.raw(spark, SF0001).limit(0))


def test_predictions_degrade_in_two_cases_only(spark):
    df = spark.createDataFrame([("a", 1)], "product string, n int")
    out, model = RK.apply_ml_predictions(df)
    assert model is None and out.first().risk_category == "Low"
    products = Qs.quad(spark, SF0001)
    same = products.withColumn("final_score", F.lit(1.0))
    got, _ = RK.apply_ml_predictions(same)
    assert {tuple(r) for r in got.select("risk_probability", "risk_category").distinct().collect()} == {(0.0, "Low")}
    full, model = RK.apply_ml_predictions(products)
    assert model.model is not None and set(products.columns) <= set(full.columns)
    assert dict(full.select(*products.columns).dtypes) == dict(products.dtypes)
