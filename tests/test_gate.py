"""The gate, statistics observed while writing, exact money, landed documents and pages."""

import json
import math
import os

import pytest
from pyspark.sql import functions as F

from revlens.functions import columns as C
from revlens.functions.stats import observed
from revlens.operators import gate as G
from revlens.operators import products as P
from revlens.operators import quality as Q
from revlens.operators import reviews as R
from revlens.operators import risk as RK
from revlens.plans import queries as Qs
from revlens.session import written
from revlens.sources import files as SF
from tests.conftest import SF001, SF0001


def _lines(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as fh:
        fh.write("\n".join(lines) + "\n")
    return folder


# ---- statistics observed while writing ---------------------------------------------------------
def test_scorer_reads_its_input_once(spark):
    """The scored plan is one scan of the written table: no join, no subquery, no exchange."""
    plan = Qs.scored(spark, SF0001)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Subquery" not in plan and "Join" not in plan and "Exchange" not in plan
    assert "lineitem" not in plan


def test_observed_values_and_odd_columns(spark):
    df = spark.createDataFrame([(1, 2.5, "x"), (2, None, "y"), (3, -1.0, None)], "a int, `A b.c` double, B string")
    df = df.select("*", F.lit(None).alias("nothing"), F.col("B").alias("b"))
    table, seen = observed(df, {"n": F.count(F.lit(1)), "low": F.min("`A b.c`")})
    assert seen == {"n": 3, "low": -1.0} and table.columns == df.columns
    assert sorted(map(str, table.collect())) == sorted(map(str, df.collect()))
    assert written(df.limit(0)).count() == 0


def test_scores_of_an_empty_and_a_constant_input(spark):
    rows = [("p", 2.0, 5.0, 7.0)] * 3
    df = spark.createDataFrame(rows, "product string, rating double, customer_ltv double, helpful_votes double")
    out = R.score_reviews(R.normalize_reviews(df)).collect()
    assert {r.ltv_norm for r in out} == {0.0} and {r.helpful_norm for r in out} == {0.0}
    assert R.score_reviews(R.normalize_reviews(df.limit(0))).count() == 0


def test_rated_reviews_agree_with_scored_ones(spark):
    norm = Qs.norm(spark, SF0001)
    keep = ["product", "rating", "is_negative", "issue_severity", "issue_category", "repeat", "verified"]
    a, b = (df.select(*keep).groupBy(*keep).count() for df in (R.rate_reviews(norm), R.score_reviews(norm)))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


# ---- money -----------------------------------------------------------------------------------------
def test_money_sums_do_not_depend_on_order(spark):
    values = [0.1, 1e9 + 0.01, -1e9, 3.33, 0.07] * 1_000 + [None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = {tuple(df.repartition(k, F.rand(k)).agg(C.money_sum("x"), C.money_avg("x")).first()) for k in (1, 3, 7)}
    want = round(1_000 * (0.1 + 0.01 + 3.33 + 0.07), 6)
    assert len(got) == 1 and next(iter(got)) == (want, want / 5_000)
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (2.0,)], "x double")
    assert tuple(odd.agg(C.money_sum("x"), C.money_avg("x")).first()) == (2.0, 2.0)


def test_flags_by_type(spark):
    df = spark.createDataFrame([(True, "yes", 2, 1.7), (None, "2", None, float("nan")), (False, "x", 0, 0.0)],
                               "b boolean, t string, i int, d double")
    got = df.select(*[C.flag_to_int(c, df.schema[c].dataType) for c in df.columns]).collect()
    assert [tuple(r) for r in got] == [(1, 1, 2, 1), (0, 2, 0, 0), (0, 0, 0, 0)]


# ---- the gate --------------------------------------------------------------------------------------
def test_gate_splits_rows_and_counts_violations(spark):
    df = spark.createDataFrame(
        [("a", "4", 1.0), (" ", "4", 1.0), (None, "bad", -1.0), ("b", "7", None), ("c", None, 2.0)],
        "product string, rating string, order_value double")
    checked = G.check_rows(df, G.input_constraints(df))
    assert [r.product for r in checked.good.collect()] == ["a"] and checked.good.columns == df.columns
    bad = {(r.product, r.rating): r.violated for r in checked.quarantine.collect()}
    assert bad[(None, "bad")] == ["product_not_blank", "rating_numeric", "order_value_range"]
    assert bad[("b", "7")] == ["rating_range", "order_value_numeric"] and len(bad) == 4
    report = {r.constraint: r.violations for r in checked.report().collect()}
    assert report["rating_numeric"] == 2 and report["product_not_blank"] == 2 and checked.rows == 5
    with pytest.raises(G.DataError, match="rating_range in 1 rows"):
        checked.raise_if_unusable()


def test_robust_pipeline_raises_on_the_way(spark):
    df = spark.createDataFrame([("2", 1.0, 5.0, "a")], "rating string, helpful_votes double, order_value double, product string")
    assert Q.robust_pipeline_checked(df).good.count() == 1
    with pytest.raises(G.DataError, match="empty"):
        Q.robust_pipeline_checked(df.limit(0))


def test_null_profile_has_a_total(spark):
    df = spark.createDataFrame([(None, 1.0), ("x", None)], "rating string, other double")
    rows = {r.column: r for r in Q.null_profile(df).collect()}
    assert tuple(rows["(total)"]) == ("(total)", 2, 50.0, True)
    none = Q.null_profile(df.where("other > 5")).collect()
    assert [tuple(r) for r in none] == [("(total)", 0, 0.0, False)]


# ---- JSON and pages ----------------------------------------------------------------------------------
def test_mixed_types_are_kept_and_broken_lines_counted(spark, tmpdir_path):
    d = _lines(tmpdir_path + "/j", "a.json", [
        json.dumps({"data": [{"product": "a", "rating": 4}, {"product": "b", "rating": "bad"}, 7]}),
        json.dumps([{"product": "c", "rating": 4.5, "tags": ["x"], "odd name": True}]), "{no", "", "12",
        json.dumps({"records": [{"product": "d", "rating": None}], "metadata": {"page": 1}}),
        json.dumps({"product": "e", "meta": {"score": 1, "deep": {"v": 2.5}}, "rating": 1})])
    landing = SF.land_documents(spark, d)
    assert landing.counts == {"documents": 6, "malformed": 1, "rows": 5}
    rows = {r["product"]: r for r in landing.reviews().collect()}
    assert {p: r["rating"] for p, r in rows.items()} == {"a": "4", "b": "bad", "c": "4.5", "d": None, "e": "1"}
    assert rows["c"]["odd name"] is True and rows["e"]["meta.deep.v"] == 2.5 and rows["c"]["tags"] == ["x"]
    norm = {r.product: r.rating for r in R.normalize_reviews(landing.reviews()).collect()}
    assert norm == {"a": 4.0, "b": 0.0, "c": 4.5, "d": 0.0, "e": 1.0}
    typed = SF.read_reviews_json(spark, d, schema="product string, rating double").collect()
    assert {r.product: r.rating for r in typed} == {"a": 4.0, "b": None, "c": 4.5, "d": None, "e": 1.0}


def test_pages_give_reviews_list_and_failures_in_one_read(spark, tmpdir_path):
    d = tmpdir_path + "/p"
    _lines(d, "page_1.json", [json.dumps({"data": [{"product": "a", "rating": 1}, {"product": "b", "rating": 2}]})])
    _lines(d, "page_2.json", ["{broken"])
    _lines(d, "page_3.json", [json.dumps({"data": [], "metadata": {"page": 3}})])
    _lines(d, "page_9.json", [json.dumps({"data": [{"product": "c", "rating": 3}], "metadata": {"page": 5}})])
    landed = SF.land_pages(spark, d)
    assert {(r.page, r.rows, r.broken) for r in landed.pages.collect()} == {(1, 2, 0), (2, 0, 1), (3, 0, 0), (5, 1, 0)}
    assert sorted(r.page for r in landed.failed().collect()) == [2, 3, 4]
    assert sorted((r.page, r.page_pos, r.product) for r in landed.reviews.collect()) == [
        (1, 0, "a"), (1, 1, "b"), (5, 0, "c")]
    one = Q.ingest_summary(R.fetch_column_repair(landed.reviews), landed.failed(7)).first()
    assert one.total_reviews == 3 and one.failed_pages == 5


# ---- risk model --------------------------------------------------------------------------------------
def test_newton_finds_the_minimum(spark):
    """The gradient of the whole penalised loss is zero at the fitted model."""
    import numpy as np

    df, feats = RK.ml_features(Qs.quad(spark, SF001))
    df = written(df)
    model = RK.train_risk_model(df, feats)
    w = np.array([*model.model.coefficients, model.model.intercept])
    label = f"final_score > {model.threshold!r}D"
    gradient, hessian = RK.newton_sums(df, model, label, w)
    assert np.abs(gradient + np.array([1.0] * len(feats) + [0.0]) * w).max() < 1e-6
    assert model.model.steps < 20 and np.allclose(hessian, hessian.T)
    p = np.array([r[0] for r in RK.predict_risk(model, df).select("risk_probability").collect()])
    assert ((p >= 0) & (p <= 1)).all() and not math.isnan(p.sum())


def test_product_table_is_written_not_recomputed(spark):
    plan = P.product_scores(Qs.scored(spark, SF0001))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[product" not in plan
