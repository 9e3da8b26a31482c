import pytest
from pyspark.sql import functions as F

from revlens.functions import constants as K
from revlens.operators import dashboard as D
from revlens.operators import products as P
from revlens.operators import reviews as R
from revlens.plans import pipeline as PL
from tests.fixtures import sample_a, upload

TOL = 1e-5


def by_product(df):
    return {r.product: r for r in df.collect()}


def test_sample_a_products_golden(spark):
    scored, prods = PL.run_service(sample_a(spark))
    got = by_product(prods)
    want = {"Atlas Desk": (.6, .643489), "Harbor Lamp": (.240909, 0.0),
            "North Mug": (.254545, 0.0), "Pulse Earbuds": (.245455, 0.0),
            "Summit Bottle": (.25, 0.0)}
    for p, (pps, fs) in want.items():
        assert got[p].PPS == pytest.approx(pps, abs=TOL)
        assert got[p].final_score == pytest.approx(fs, abs=TOL)
        assert got[p].quadrant == K.NOISE
    dec = by_product(P.make_decisions(prods))
    assert {r.action for r in dec.values()} == {K.DECISION_FIX}


def test_upload_dashboard_products_golden(spark):
    scored, prods = PL.run_pipeline(upload(spark))
    got = by_product(prods)
    want = {
        "Atlas Desk": (.564750, 2.15, 1.0, 20000, .342, .600848),
        "Harbor Lamp": (.379877, 2.05, 1.0, 14000, .350, .434693),
        "North Mug": (0, 4.0, 0, 0, .044, 0),
        "Pulse Earbuds": (0, 4.0, 0, 0, .044, 0),
        "Summit Bottle": (0, 4.55, 0, 0, 0, 0),
    }
    for p, (imp, rating, neg, rev, pps, fs) in want.items():
        r = got[p]
        assert r.total_impact == pytest.approx(imp, abs=TOL)
        assert r.avg_rating == pytest.approx(rating, abs=TOL)
        assert r.negative_ratio == pytest.approx(neg, abs=TOL)
        assert r.total_revenue_at_risk == pytest.approx(rev, abs=TOL)
        assert r.PPS == pytest.approx(pps, abs=1e-3)
        assert r.final_score == pytest.approx(fs, abs=TOL)
        assert r.quadrant == K.NOISE
    th = P.quadrant_thresholds(prods).first()
    assert th.p75_revenue == pytest.approx(14000)
    assert th.p75_negative == pytest.approx(1.0)
    assert th.p75_impact == pytest.approx(.379877, abs=TOL)
    dec = by_product(P.make_decisions(prods))
    assert dec["Atlas Desk"].action == dec["Harbor Lamp"].action == K.DECISION_FIX
    assert {dec[p].action for p in ["North Mug", "Pulse Earbuds", "Summit Bottle"]} == {
        K.DECISION_MONITOR}
    recs = {r.name: r for r in D.dashboard_records(prods, as_of="2024-01-01").collect()}
    assert recs["Atlas Desk"].finalScore == 1.0
    assert recs["Harbor Lamp"].finalScore == pytest.approx(0.72)
    assert recs["Atlas Desk"].revenueAtRisk == 20000
    assert recs["Atlas Desk"].impact == 20


def test_upload_service_products_golden(spark):
    scored, prods = PL.run_service(upload(spark))
    assert {round(r.CIS, 6) for r in scored.collect()} == {0.177013}
    got = by_product(prods)
    want = {"Harbor Lamp": (.227461, 2000, .350, .276680),
            "Atlas Desk": (.222151, 2000, .342, .269222),
            "North Mug": (0, 0, .044, 0), "Pulse Earbuds": (0, 0, .044, 0),
            "Summit Bottle": (0, 0, 0, 0)}
    for p, (imp, rev, pps, fs) in want.items():
        r = got[p]
        assert r.total_impact == pytest.approx(imp, abs=TOL)
        assert r.total_revenue_at_risk == pytest.approx(rev, abs=TOL)
        assert r.PPS == pytest.approx(pps, abs=1e-3)
        assert r.final_score == pytest.approx(fs, abs=TOL)


def test_spike_score_golden(spark):
    rows = []
    # product A: 14 of 15 reviews within the window -> 2.0040 (boost)
    for i in range(15):
        rows.append(("A", f"2024-06-{30 - (0 if i < 14 else 20):02d}"))
    for i in range(14):
        rows.append(("B", f"2024-06-{30 - (0 if i < 13 else 20):02d}"))
    df = spark.createDataFrame(rows, "product string, review_date string")
    got = {r.product: r.spike_score for r in P.spike_stats(df).collect()}
    assert got["A"] == pytest.approx(2.0040, abs=1e-4)
    assert got["B"] == pytest.approx(1.9835, abs=1e-4)


def test_product_metrics_properties(spark):
    from tests.conftest import SF0001
    from revlens.sources.tables import review_view

    scored = R.score_reviews(R.normalize_reviews(review_view(spark, SF0001)))
    prods = P.quadrant_priority(P.classify_quadrants(P.product_scores(scored)))
    s = scored.agg(F.count("*").alias("n"),
                   F.sum(F.when(F.col("rating") <= 2.5, F.col("customer_ltv"))).alias("rev"),
                   F.count_if(~F.col("CIS").between(0, 1)).alias("bad_cis"),
                   F.count_if((F.col("rating") > 3) & (F.col("impact_score") != 0))
                   .alias("bad_gate")).first()
    p = prods.agg(F.sum("total_reviews").alias("n"), F.sum("total_revenue_at_risk").alias("rev"),
                  F.count_if(F.col("quadrant").isNull()).alias("nq")).first()
    assert s.n == p.n and s.bad_cis == 0 and s.bad_gate == 0 and p.nq == 0
    assert s.rev == pytest.approx(p.rev)


def test_top3_and_rankings(spark):
    _, prods = PL.run_pipeline(upload(spark))
    flags = {r.product: r.is_top3 for r in D.top3_flag(prods).collect()}
    assert flags["Atlas Desk"] and flags["Harbor Lamp"] and sum(flags.values()) == 3
    assert D.top_product(prods).first().top_product == "Atlas Desk"
    assert [r.product for r in P.rank_products(prods).limit(2).collect()] == [
        "Atlas Desk", "Harbor Lamp"]
