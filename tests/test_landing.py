"""Work and memory of landing and of scaling grow with the input, not faster."""

import glob
import json
import os

from pyspark.sql import functions as F

from revlens.operators import quality as Q
from revlens.operators import reviews as R
from revlens.plans import queries as Qs
from revlens.sources import files as SF
from revlens.sources import tables as TB
from tests.conftest import SF0001


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _pages(spark, path, pages, without=()):
    df = spark.range(1, pages + 1).where(~F.col("id").isin(list(without))).selectExpr(
        "cast(id as int) as page", "concat('p', id % 7) as product", "cast(id % 5 as double) as customer_ltv")
    SF.write_review_pages(df, path)
    return path


# ---- failed pages ------------------------------------------------------------------------------------
def test_gap_report_keeps_pages_out_of_the_driver(spark, tmpdir_path):
    missing = [3, SF.GAP_BLOCK, SF.GAP_BLOCK + 1, 2 * SF.GAP_BLOCK - 1, 9_999]
    gaps = SF.page_gap_report(spark, SF.page_envelopes(spark, _pages(spark, tmpdir_path + "/p", 10_000, missing)))
    assert "Broadcast" not in _plan(gaps)
    assert sorted(r.page for r in gaps.collect()) == missing


def test_ingest_summary_broadcasts_one_row_only(spark, tmpdir_path):
    landed = SF.land_pages(spark, _pages(spark, tmpdir_path + "/p", 500, [7, 8]))
    one = Q.ingest_summary(R.fetch_column_repair(landed.reviews), landed.failed())
    assert "BroadcastHashJoin" not in _plan(one)
    row = one.first()
    assert (row.total_reviews, row.unique_products, row.failed_pages) == (498, 7, 2)


def _tables(spark, path):
    """Three orders, one without lines and one without a customer; keys repeat and are null."""
    for name, rows, schema in (
            ("customer", [(1, 10.0), (1, -5.0), (None, 7.0)], "c_custkey long, c_acctbal double"),
            ("part", [(1, "a", "x"), (2, "b", "y"), (None, "c", "z")], "p_partkey long, p_name string, p_brand string"),
            ("orders", [(1, 1, 100.0), (2, 9, 200.0), (4, 1, 300.0), (6, 1, 400.0), (None, 1, 500.0)],
             "o_orderkey long, o_custkey long, o_totalprice double"),
            ("lineitem", [(1, 1, 1), (1, 2, 2), (2, 1, 1), (4, 1, 2), (4, 2, 3), (4, 3, None), (None, 1, 1)],
             "l_orderkey long, l_linenumber int, l_partkey long")):
        df = spark.createDataFrame(rows, schema)
        if name == "lineitem":
            df = df.selectExpr("*", "1D as l_quantity", "'N' as l_returnflag", "timestamp_ntz '2024-01-01' as l_shipdate")
        df.write.parquet(f"{path}/{name}.parquet")
    return path


def test_reviews_are_joined_without_tables_in_the_driver(spark, tmpdir_path):
    path = _tables(spark, tmpdir_path)
    base = TB._base(spark, path)
    assert "Broadcast" not in _plan(base) and _plan(base).count("SortMergeJoin") == 3
    assert sorted((r.ok, r.ln, r.pk, r.ck, r.tp, r.ab, r.pn, r.br) for r in base.collect()) == [
        (ok, ln, pk, 1, tp, ab, *{1: ("a", "x"), 2: ("b", "y")}[pk])
        for ok, ln, pk, tp in ((1, 1, 1, 100.0), (1, 2, 2, 100.0), (4, 1, 2, 300.0)) for ab in (-5.0, 10.0)]
    assert "Broadcast" not in _plan(base)  # nor as run


def test_ingest_summary_sends_no_table_through_the_driver(spark, tmpdir_path, monkeypatch):
    landed = []
    write = SF.write_review_pages
    monkeypatch.setattr(SF, "write_review_pages", lambda df, path: (landed.append(_plan(df)), write(df, path)))
    row = Qs.QUERIES["ingest_summary"](spark, _tables(spark, tmpdir_path)).first()
    assert len(landed) == 1 and "Broadcast" not in landed[0]
    assert (row.total_reviews, row.unique_products, row.ltv_min, row.ltv_max, row.ltv_sum, row.failed_pages) == (
        6, 2, 0.0, 10.0, 30.0, 3)


# ---- scaling -----------------------------------------------------------------------------------------
def test_minmax_reads_and_joins_once(spark):
    for name in ("minmax", "minmax_safe", "minmax_eps"):
        plan = _plan(Qs.QUERIES[name](spark, SF0001))
        assert plan.count("FileScan") == 1 and "Join" not in plan, name


def test_minmax_column_with_and_without_bounds(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, 5.0), (None, float("nan")), (2.0, 7.0)], "x double, y double")
    whole, bounds = R.column_bounds(df)
    for variant in ("const0", "safe", "eps"):
        for c in ("x", "y"):
            own = R.minmax_column(df, c, "n", variant)
            assert own.columns == ["x", "y", "n"]
            with_bounds = R.minmax_column(whole, c, "n", variant, bounds=bounds[c])
            assert (sorted(map(str, own.collect())) == sorted(map(str, with_bounds.collect())))
    assert [r.n for r in R.minmax_column(df, "x", "n", "safe").orderBy("x").collect()] == [None, 0.0, 0.5, 1.0]


# ---- landed documents --------------------------------------------------------------------------------
def _files(path):
    return glob.glob(f"{path}/part-*")


def test_pages_are_landed_compressed_in_small_files(spark, tmpdir_path):
    from revlens.streaming import pages as ST

    path = _pages(spark, tmpdir_path + "/p", 30_000)
    files = _files(path)
    assert files and all(f.endswith(".json.snappy") for f in files)
    assert sum(map(os.path.getsize, files)) < spark.read.text(path).agg(F.sum(F.length("value"))).first()[0] / 2
    small = spark.range(2 * SF.LANDED["maxRecordsPerFile"] + 1).selectExpr("cast(id as int) as page", "'a' as product")
    SF.write_review_pages(small.coalesce(1), tmpdir_path + "/q")
    assert all(spark.read.text(f).count() <= SF.LANDED["maxRecordsPerFile"] for f in _files(tmpdir_path + "/q"))
    back = SF.read_review_pages(spark, path)
    assert back.count() == 30_000 and back.select("page").distinct().count() == 30_000
    ST.land_pages(spark, path, tmpdir_path + "/t", tmpdir_path + "/c")
    assert spark.read.parquet(tmpdir_path + "/t").select("page").distinct().count() == 30_000


def test_mixed_documents_are_made_in_one_pass_and_compressed(spark, tmpdir_path, monkeypatch):
    monkeypatch.setattr(Qs, "scratch_path", lambda spark, name: f"{tmpdir_path}/{name}")
    got = Qs.QUERIES["read_reviews_json_mixed"](spark, SF0001)
    assert got.count() == Qs.reviews(spark, SF0001).count()
    files = _files(f"{tmpdir_path}/json-mixed")
    assert files and all(f.endswith(".txt.snappy") for f in files)
    docs = [json.loads(r.value) for r in spark.read.text(f"{tmpdir_path}/json-mixed").collect()]
    shapes = [next((k for k in ("data", "records") if k in d), "flat") for d in docs]
    lines = spark.read.parquet(f"{SF0001}/lineitem.parquet").selectExpr("l_orderkey % 3 as k", "l_orderkey as o")
    want = {r.k: (r.docs, r.rows) for r in lines.groupBy("k").agg(
        F.count_distinct("o").alias("docs"), F.count("o").alias("rows")).collect()}
    assert {s: shapes.count(s) for s in set(shapes)} == {
        "data": want[0][0], "records": want[1][0], "flat": want[2][1]}


def test_json_documents_are_landed_compressed(spark, tmpdir_path, monkeypatch):
    monkeypatch.setattr(Qs, "scratch_path", lambda spark, name: f"{tmpdir_path}/{name}")
    got = Qs.QUERIES["read_reviews_json"](spark, SF0001)
    assert got.count() == Qs.reviews(spark, SF0001).count()
    files = _files(f"{tmpdir_path}/json")
    assert files and all(f.endswith(".json.snappy") for f in files)
