import json
import os

from revlens.streaming import pages as ST


def _page(d, n, rows):
    os.makedirs(d, exist_ok=True)
    with open(os.path.join(d, f"page_{n}.json"), "w") as fh:
        fh.write(json.dumps({"data": rows, "metadata": {"page": n}}) + "\n")


def test_running_totals_are_incremental(spark, tmpdir_path):
    pages, sink, ckpt = (os.path.join(tmpdir_path, x) for x in ("pages", "sink", "ckpt"))
    _page(pages, 1, [{"product": " A ", "rating": 2.0, "customer_ltv": 100.0},
                     {"product": "B", "rating": 5.0, "customer_ltv": 50.0}])
    _page(pages, 2, [{"product": "A", "rating": 4.0, "customer_ltv": 10.0}])
    agg = ST.running_revenue_at_risk(ST.page_stream(spark, pages))
    ST.run_available(agg, sink, ckpt)
    got = {r.product: (r.total_reviews, r.negative_count, r.total_revenue_at_risk)
           for r in spark.read.parquet(sink).collect()}
    assert got == {"A": (2, 1, 100.0), "B": (1, 0, 0.0)}
    # a new page lands: only it is read, state carries the earlier totals
    _page(pages, 3, [{"product": "B", "rating": 1.0, "customer_ltv": 7.0}])
    ST.run_available(ST.running_revenue_at_risk(ST.page_stream(spark, pages)), sink, ckpt)
    got = {r.product: (r.total_reviews, r.negative_count, r.total_revenue_at_risk)
           for r in spark.read.parquet(sink).collect()}
    assert got == {"A": (2, 1, 100.0), "B": (2, 1, 7.0)}


def test_land_pages_exactly_once(spark, tmpdir_path):
    pages, table, ckpt = (os.path.join(tmpdir_path, x) for x in ("pages", "table", "ckpt"))
    _page(pages, 1, [{"product": "A", "rating": 2.0}])
    ST.land_pages(spark, pages, table, ckpt)
    ST.land_pages(spark, pages, table, ckpt)          # nothing new: no duplicates
    assert spark.read.parquet(table).count() == 1
    _page(pages, 2, [{"product": "B", "rating": 3.0}, {"product": "", "rating": 1.0}])
    ST.land_pages(spark, pages, table, ckpt)
    assert sorted(r.product for r in spark.read.parquet(table).collect()) == ["A", "B"]
