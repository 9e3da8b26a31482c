"""Plan-shape checks: the scale rules of the design, checked on real plans."""

import pytest

from revlens.plans import queries as Qs
from tests.conftest import SF0001

CHECKED = ["run_pipeline", "score_reviews", "classify_quadrants", "review_count_window",
           "top3_flag", "issue_breakdown", "kpis", "make_decisions", "quantile_thresholds",
           "ml_features", "enrich_products", "dashboard_records"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", CHECKED)
def test_no_python_udf_and_no_global_window(spark, name):
    plan = _plan(Qs.QUERIES[name](spark, SF0001))
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    # no window over an un-partitioned (single partition) input
    for line in plan.splitlines():
        if "Window [" in line:
            assert "SinglePartition" not in line


def test_scan_prunes_columns_and_pushes_filters(spark):
    from pyspark.sql import functions as F

    from revlens.sources.tables import read_table

    df = read_table(spark, SF0001, "lineitem").filter(F.col("l_quantity") > 10) \
        .select("l_orderkey", "l_quantity")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_entry_contract(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and "quadrant" in df.columns
    qs, orc = E.queries(), E.oracle_sql()
    assert set(orc) <= set(qs)
    assert len(qs) >= 120
