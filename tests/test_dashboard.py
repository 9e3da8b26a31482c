"""Client-side record operators on the reference's eight sample records (FIXTURES D)."""

import pytest
from pyspark.sql import functions as F

from revlens.operators import dashboard as D
from revlens.operators import insights as I

# ---- fixed values: the eight sample product records ------------------------------
RECORDS = [
    ("Atlas Desk", "2026-04-08", 0.91, 920000, 0.92, 34.2, "Fire Fight", 88, 86, 2.8, "Rising", "High", 4860, (162, 204, 74, 88)),
    ("Pulse Earbuds", "2026-04-09", 0.84, 640000, 0.86, 29.5, "Fire Fight", 79, 78, 3.1, "Rising", "High", 3980, (104, 176, 58, 66)),
    ("North Mug", "2026-04-03", 0.73, 410000, 0.74, 21.3, "VIP Nudge", 34, 82, 3.6, "Stable", "Medium", 2510, (62, 84, 40, 29)),
    ("Harbor Lamp", "2026-03-30", 0.68, 285000, 0.69, 24.8, "Slow Burn", 68, 44, 3.4, "Rising", "Medium", 2715, (58, 76, 49, 44)),
    ("Summit Bottle", "2026-03-26", 0.61, 198000, 0.63, 17.2, "Slow Burn", 59, 39, 3.9, "Stable", "Medium", 2330, (47, 53, 61, 25)),
    ("Vale Chair", "2026-03-22", 0.57, 144000, 0.58, 14.1, "Noise", 24, 34, 4.1, "Falling", "Low", 1820, (18, 31, 22, 17)),
    ("Cove Kettle", "2026-03-18", 0.51, 102000, 0.49, 12.4, "Noise", 18, 28, 4.2, "Stable", "Low", 1585, (14, 20, 19, 12)),
    ("Drift Frame", "2026-03-14", 0.46, 89000, 0.44, 10.9, "Noise", 16, 24, 4.4, "Falling", "Low", 1420, (11, 18, 15, 10)),
]
SCHEMA = ("name string, date string, finalScore double, revenueAtRisk bigint, riskProbability double, "
          "negativePct double, quadrant string, frequency bigint, impact bigint, rating double, "
          "trend string, severity string, totalReviews bigint, "
          "issues struct<delivery:bigint,quality:bigint,packaging:bigint,support:bigint>")


@pytest.fixture()
def recs(spark):
    return spark.createDataFrame(RECORDS, SCHEMA)


def test_filter_records_defaults(recs):
    got = {r.name for r in D.filter_records(recs, None, "2026-03-01", "2026-04-10").collect()}
    assert got == {"Atlas Desk", "Pulse Earbuds", "North Mug"}
    med = D.filter_records(recs, None, "2026-03-01", "2026-04-10", "Medium", 0.0)
    assert med.count() == 3


def test_kpis_weighted(recs):
    k = D.kpis_weighted(recs).first()
    total = sum(r[12] for r in RECORDS)
    weighted = sum(r[5] / 100 * r[12] for r in RECORDS) / total
    assert k.total_revenue == sum(r[3] for r in RECORDS) and k.total_reviews == total
    assert k.negative_pct == pytest.approx(weighted * 100)
    assert k.high_risk_count == 2 and k.negative_note == "Above baseline"


def test_issue_totals_and_top_two(recs):
    tot = {r.issue: r.total for r in D.issue_totals(recs).collect()}
    assert tot == {"delivery": 476, "quality": 662, "packaging": 338, "support": 291}
    assert [r.issue for r in D.top_two_issues(recs).collect()] == ["quality", "delivery"]


def test_sort_search_and_cards(recs):
    order = [r.name for r in D.sort_records(recs, "negative", "asc").collect()]
    assert order[0] == "Drift Frame" and order[-1] == "Atlas Desk"
    assert {r.name for r in D.search_products(recs, "mug").collect()} == {"North Mug"}
    cards = {r.name: r.card_text for r in I.product_card_text(recs).collect()}
    assert cards["Atlas Desk"].startswith("High priority: 88 issues detected. Top concern: quality")
    assert cards["Drift Frame"].startswith("Low risk profile with 16 issues.")


def test_portfolio_summary_and_prompt(recs):
    s = I.portfolio_summary(recs).first()
    assert s.top_revenue_product == "Atlas Desk" and s.top_impact_product == "Atlas Desk"
    assert s.summary.startswith("Atlas Desk carries the largest revenue exposure at $920,000, "
                                "driven by elevated quality complaints and a risk probability of 0.92.")
    assert "Quality and delivery account for most issue volume" in s.summary
    prompt = I.portfolio_prompt(recs).collect()
    assert len(prompt) == recs.count() + 1  # one row per record and the totals
    assert any(r.prompt.startswith('{"name":"Atlas Desk"') for r in prompt)
    assert [r.prompt for r in prompt if r.kind == "issueTotals"] == [
        '{"delivery":476,"quality":662,"packaging":338,"support":291}']


def test_ties_go_by_score_then_name(spark):
    df = spark.createDataFrame([("b", 0.5, 1.25), ("a", 0.5, 1.0), ("c", 0.5, 1.25)],
                               "name string, riskProbability double, score double")
    assert [r.name for r in D.top_n(df, "riskProbability", 3, "name").collect()] == ["b", "c", "a"]
    assert [r.name for r in D.sort_records(df, "probability", "asc").collect()] == ["b", "c", "a"]


def test_severity_distribution(recs):
    got = {r.severity: (r.products, r.share) for r in D.severity_distribution(recs).collect()}
    assert got["High"] == (2, 0.25) and got["Low"][0] == 3
