import pytest

from revlens.operators import risk as RK
from revlens.plans import pipeline as PL
from tests.fixtures import sample_a, upload


def _probs(prods):
    out, model = RK.apply_ml_predictions(prods, checkpoint=False)
    return {r.product: r for r in out.collect()}, model


def test_sample_a_risk_golden(spark):
    _, prods = PL.run_service(sample_a(spark))
    got, model = _probs(prods)
    want = {"Atlas Desk": .7869, "Harbor Lamp": .0629, "North Mug": .0433,
            "Pulse Earbuds": .0651, "Summit Bottle": .0418}
    for p, v in want.items():
        assert got[p].risk_probability == pytest.approx(v, abs=1e-3)
    assert got["Atlas Desk"].risk_category == "High"
    assert model.stats["high_risk_count"] == 1


def test_upload_dashboard_risk_golden(spark):
    _, prods = PL.run_pipeline(upload(spark))
    got, _ = _probs(prods)
    want = {"Atlas Desk": .5856, "Harbor Lamp": .3384, "North Mug": .0258,
            "Pulse Earbuds": .0258, "Summit Bottle": .0243}
    for p, v in want.items():
        assert got[p].risk_probability == pytest.approx(v, abs=1e-3)


def test_single_class_degrades_to_defaults(spark):
    df = spark.createDataFrame([("A", 2.0, "x", 10), ("B", 2.0, "y", 10)],
                               "product_name string, rating double, review_text string, ltv bigint")
    _, prods = PL.run_pipeline(df)
    got, model = _probs(prods)
    assert model is not None and model.model is None
    assert {r.risk_probability for r in got.values()} == {0.0}
    assert {r.risk_category for r in got.values()} == {"Low"}


def test_feature_importance_and_stats(spark):
    _, prods = PL.run_service(sample_a(spark))
    feats_df, feats = RK.ml_features(prods)
    model = RK.train_risk_model(feats_df, feats)
    imp = RK.feature_importance(model, spark).collect()
    assert len(imp) == 11
    assert imp[0].abs_coefficient >= imp[-1].abs_coefficient
    st = RK.training_stats(model, feats_df).first()
    assert st.samples_trained == 5 and st.num_features == 11
    assert 0.0 <= st.training_accuracy <= 1.0
