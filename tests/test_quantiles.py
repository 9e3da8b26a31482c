import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from revlens.functions.stats import quantiles


def _np_q(vals, q):
    vals = [v for v in vals if v is not None]
    return float(np.quantile(np.array(vals, dtype=float), q)) if vals else None


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-20, 20).map(float),
                          st.floats(-1e6, 1e6, allow_nan=False)), min_size=0, max_size=60),
       st.sampled_from([0.0, 0.25, 0.5, 0.75, 1.0]))
def test_bracket_matches_numpy_small(spark, vals, q):
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = quantiles(df, [("p", "x", q)], method="bracket").first().p
    want = _np_q(vals, q)
    if want is None:
        assert got is None
    else:
        assert got == pytest.approx(want, rel=1e-12, abs=1e-9)


@pytest.mark.parametrize("dist", ["uniform", "dupes", "zeros"])
def test_bracket_approx_path_is_exact(spark, dist):
    rng = np.random.default_rng(7)
    n = 20000
    if dist == "uniform":
        vals = rng.random(n)
    elif dist == "dupes":
        vals = rng.integers(0, 50, n).astype(float)
    else:
        vals = np.where(rng.random(n) < 0.8, 0.0, rng.random(n))
    df = spark.createDataFrame([(float(v),) for v in vals], "x double").repartition(7)
    # accuracy far below n forces the percentile_approx bracket path
    row = quantiles(df, [("a", "x", 0.75), ("b", "x", 0.25), ("c", "x", 0.5)],
                    method="bracket", accuracy=500).first()
    assert row.a == pytest.approx(float(np.quantile(vals, 0.75)), rel=1e-12)
    assert row.b == pytest.approx(float(np.quantile(vals, 0.25)), rel=1e-12)
    assert row.c == pytest.approx(float(np.quantile(vals, 0.5)), rel=1e-12)
    ex = quantiles(df, [("a", "x", 0.75)], method="exact").first().a
    assert ex == pytest.approx(row.a, rel=1e-12)
