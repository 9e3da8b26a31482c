"""End-to-end compositions of the operators.

Materialisation policy: what statistics are taken of is written once to the shared folder while
they are observed (the scorer's input), and so is the product table, which several passes read;
the rest is lazy. A caller that reuses the scored reviews many times (dashboards) may pass
``keep=True`` to write them and the product table with all columns, too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from revlens.operators import products as P
from revlens.operators import reviews as R
from revlens.session import written


def _keep(df: DataFrame, keep: bool) -> DataFrame:
    return written(df, "kept") if keep else df


def run_pipeline(raw: DataFrame, keep: bool = False, quantile_method: str = "bracket") -> tuple[DataFrame, DataFrame]:
    """Dashboard path: normalise -> score -> product scores -> quadrants -> priority.
    Returns ``(scored_reviews, products)``."""
    scored = _keep(R.score_reviews(R.normalize_reviews(raw)), keep)
    products = P.quadrant_priority(P.classify_quadrants(P.product_scores(scored),
                                                        method=quantile_method))
    return scored, _keep(products, keep)


def run_service(raw: DataFrame, keep: bool = False, quantile_method: str = "bracket") -> tuple[DataFrame, DataFrame]:
    """Service path: required columns -> service profile -> score -> products ->
    quadrants. Raises ``ValueError`` when product or rating cannot be found."""
    ok, msg = R.check_required_columns(raw)
    if not ok:
        raise ValueError(f"Schema validation failed: {msg}")
    scored = _keep(R.score_reviews(R.normalize_reviews_service(raw)), keep)
    products = P.classify_quadrants(P.product_scores(scored), method=quantile_method)
    return scored, _keep(products, keep)


def flagship(raw: DataFrame) -> DataFrame:
    """"Which products cost us most?": ranked products with quadrant and priority."""
    _, products = run_pipeline(raw)
    return P.rank_products(products)


def run_classic(raw: DataFrame, quantile_method: str = "bracket") -> DataFrame:
    """Older path: preprocess -> features -> scores -> product metrics -> decisions."""
    from revlens.operators import classic as CL

    rev = CL.classic_scores(CL.classic_features(CL.classic_preprocess(raw)))
    return P.make_decisions(P.classic_product_metrics(rev), method=quantile_method)


def filtered_dashboard(raw: DataFrame, products=None, date_range=None,
                       severity_threshold: float = 0.0, risk_threshold: float = 0.0,
                       keep: bool = False, insight_top_n: int = 5):
    """Dashboard steps after loading: score everything (the scorer's statistics
    come from the whole set), fit the risk model on all products, then filter
    reviews, re-aggregate and re-classify the survivors, restore the earlier
    predictions, apply the risk threshold, keep the reviews of the surviving
    products (semi join), attach insights, and compute the KPI row.

    Returns the KPI row; ``filtered_dashboard_frames`` returns every table."""
    return filtered_dashboard_frames(raw, products, date_range, severity_threshold,
                                     risk_threshold, keep, insight_top_n)["kpis"]


def filtered_dashboard_frames(raw: DataFrame, products=None, date_range=None,
                              severity_threshold: float = 0.0, risk_threshold: float = 0.0,
                              keep: bool = False, insight_top_n: int = 5) -> dict:
    from revlens.operators import dashboard as D
    from revlens.operators import insights as I
    from revlens.operators import risk as RK

    scored, prods = run_pipeline(raw, keep=keep)
    ml, _model = RK.apply_ml_predictions(prods)
    preds = ml.select("product", "risk_probability", "risk_category", "high_risk_predicted")
    reviews = D.apply_filters(scored, products, date_range, severity_threshold)
    agg = P.quadrant_priority(P.classify_quadrants(P.product_scores(reviews)))
    agg = D.join_predictions(agg, preds)
    agg = D.filter_risk(agg, risk_threshold)
    if risk_threshold > 0:
        reviews = D.reviews_of_products(reviews, agg)
    agg = I.enrich_products(agg, insight_top_n)
    return {"reviews": reviews, "products": agg,
            "kpis": D.kpis_enhanced(reviews, agg)}
