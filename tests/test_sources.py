import json
import os

import pytest
from pyspark.sql import functions as F

from revlens.operators import reviews as R
from revlens.sources import files as SF
from tests.fixtures import UPLOAD_CSV


def _write(path, name, text):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w") as fh:
        fh.write(text)
    return os.path.join(path, name)


def test_csv_upload_dashboard_profile(spark, tmpdir_path):
    p = _write(tmpdir_path, "upload.csv", UPLOAD_CSV + "Ghost,NA,,\n   ,4.0,x,1\n")
    df = SF.read_reviews_csv(spark, p)
    assert set(df.columns) == {"product_name", "rating", "review_text", "ltv"}
    norm = {(r.product, r.rating): r for r in R.normalize_reviews(df).collect()}
    assert len(norm) == 11          # the blank product is dropped
    ghost = norm[("Ghost", 0.0)]    # 'NA' rating -> 0 in the dashboard profile
    assert ghost.customer_ltv == 0.0 and ghost.review_text is None
    assert norm[("Atlas Desk", 2.5)].customer_ltv == 10000.0
    svc = {r.product for r in R.normalize_reviews_service(df).collect()}
    assert "   " in svc and "Ghost" in svc


def test_json_four_shapes(spark, tmpdir_path):
    rows = [{"product": "A", "rating": 2}, {"product": "B", "rating": 5}]
    arr = _write(tmpdir_path + "/a", "a.json", json.dumps(rows))
    data = _write(tmpdir_path + "/d", "d.json", json.dumps({"data": rows, "metadata": {}}))
    recs = _write(tmpdir_path + "/r", "r.json", json.dumps({"records": rows}))
    obj = _write(tmpdir_path + "/o", "o.json",
                 json.dumps({"product": "C", "meta": {"score": 4, "ltv": {"v": 9}}}))
    for p in (arr, data, recs):
        got = sorted((r.product, r.rating) for r in SF.read_reviews_json(spark, p).collect())
        assert got == [("A", 2), ("B", 5)]
    flat = SF.read_reviews_json(spark, obj)
    assert set(flat.columns) == {"product", "meta.score", "meta.ltv.v"}
    assert flat.first()["meta.ltv.v"] == 9


def test_pages_gap_cap_and_repair(spark, tmpdir_path):
    d = tmpdir_path + "/pages"
    _write(d, "page_1.json", json.dumps({"data": [{"product": " A ", "rating": 1,
                                                    "customer_ltv": "12"}]}) + "\n")
    _write(d, "page_2.json", json.dumps({"data": []}) + "\n")
    _write(d, "page_3.json", json.dumps({"data": [{"product": None, "rating": 4}]}) + "\n")
    env = SF.page_envelopes(spark, d)
    gaps = sorted(r.page for r in SF.page_gap_report(spark, env, requested=4).collect())
    assert gaps == [2, 4]
    rows = R.fetch_column_repair(SF.read_review_pages(spark, d)).orderBy("page").collect()
    assert [(r.page, r.product, r.customer_ltv) for r in rows] == [(1, "A", 12.0),
                                                                   (3, "General", 0.0)]
    assert SF.read_review_pages(spark, d, max_pages=1).count() == 1
    loaded = SF.load_reviews(spark, "pages", d)
    assert loaded.count() == 2 and "days_since_purchase" in loaded.columns


def test_empty_pages_raise(spark, tmpdir_path):
    d = tmpdir_path + "/empty"
    _write(d, "page_1.json", json.dumps({"data": []}) + "\n")
    with pytest.raises(SF.SourceError):
        SF.load_reviews(spark, "pages", d)


def test_dashboard_json_round_trip(spark, tmpdir_path):
    from revlens.operators import dashboard as D
    from revlens.plans import pipeline as PL
    from tests.fixtures import upload

    _, prods = PL.run_pipeline(upload(spark))
    recs = D.dashboard_records(prods, as_of="2024-01-01")
    SF.write_dashboard_json(recs, tmpdir_path + "/dash")
    back = spark.read.json(tmpdir_path + "/dash")
    assert back.count() == 5
    assert back.filter(F.col("name") == "Atlas Desk").first().issues.quality == 0


def test_sample_reviews_scores_like_golden_a(spark):
    from revlens.plans import pipeline as PL
    from revlens.sources.samples import sample_reviews

    df = sample_reviews(spark, "2024-01-01T00:00:00")
    assert df.count() == 5 and {r.review_date for r in df.collect()} == {"2024-01-01T00:00:00"}
    _, prods = PL.run_service(df)
    fs = {r.product: r.final_score for r in prods.collect()}
    assert abs(fs["Atlas Desk"] - 0.643489) < 1e-5
