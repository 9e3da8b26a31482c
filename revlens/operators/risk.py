"""Product risk model: L2 logistic regression by Newton's method on aggregates.

Parity with the reference's scaler + logistic regression: features are standardised with the
POPULATION standard deviation (zero spread -> scale 1), the loss is ``0.5 ||w||^2 + sum(logloss)``
(C = 1) with a free intercept, and the result is its only minimum.

Every Newton step is one aggregate over the product table: the gradient and the (features + 1)
squared Gram matrix of the standardised features, weighted by p (1 - p), which partial
aggregation sums on the executors. That row of sums has a size that the number of products does
not change; the small system is solved on the driver. A step longer than ``STEP_CAP`` in one
coordinate is shortened; steps end when they are below ``TOLERANCE``. The same steps are plain
SQL (``plans/oracle.py``), so the fitted model has an oracle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.functions import columns as C
from revlens.functions import constants as K
from revlens.functions.stats import quantiles, with_stats
from revlens.session import written

STEP_CAP = 5.0
TOLERANCE = 1e-8
MAX_STEPS = 50
PREDICTIONS = ["risk_probability", "risk_category", "high_risk_predicted"]


class MissingColumns(ValueError):
    """Critical feature columns are missing."""


def ml_features(products: DataFrame) -> tuple[DataFrame, list[str]]:
    """Derived product features and the feature list (missing ones skipped);
    raises when a critical input column is missing; null/inf -> 0."""
    missing = [c for c in K.ML_CRITICAL if c not in products.columns]
    if missing:
        raise MissingColumns(f"Missing critical features: {missing}")
    df = products
    n, tot, neg = F.col("total_reviews"), F.col("total_impact"), F.col("negative_ratio")
    ex = {
        "impact_per_review": F.when(n > 0, tot / n).otherwise(F.lit(0.0)),
        "negative_reviews": F.when(n > 0, F.bround(neg * n, 0).cast("int")).otherwise(F.lit(0)),
    }
    if "avg_severity" not in df.columns:
        ex["avg_severity"] = C.clip01(neg)
    else:
        ex["avg_severity"] = F.coalesce(F.col("avg_severity"), neg)
    if "rating_drop" not in df.columns:
        ex["rating_drop"] = (C.clip(F.lit(5.0) - F.col("avg_rating"), 0.0, 5.0)
                             if "avg_rating" in df.columns else F.lit(0.0))
    ex["rating_drop"] = F.coalesce(ex.get("rating_drop", F.col("rating_drop")), F.lit(0.0))
    if "recency_score" not in df.columns:
        ex["recency_score"] = F.lit(0.0)
    df = df.withColumns(ex)
    df = df.withColumns({
        "review_velocity": F.col("total_reviews") * (F.lit(1.0) + F.col("recency_score")),
        "severity_impact": F.col("avg_severity") * F.col("impact_per_review"),
    })
    feats = [f for f in K.ML_FEATURES if f in df.columns]
    clean = {}
    for f in feats:
        v = F.col(f).cast("double")
        clean[f] = F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(0.0)) \
            .otherwise(v)
    return df.withColumns(clean), feats


def risk_labels(df: DataFrame, quantile: float = K.QUADRANT_QUANTILE,
                method: str = "bracket") -> DataFrame:
    """``high_risk = final_score > quantile(final_score)``; keeps the threshold."""
    th = quantiles(df, [("risk_threshold", "final_score", quantile)], method=method)
    j = with_stats(df, th)
    return j.withColumn("high_risk", (F.col("final_score") > F.col("risk_threshold")).cast("int"))


@dataclass
class Fitted:
    coefficients: list[float]
    intercept: float
    steps: int


@dataclass
class RiskModel:
    features: list[str]
    means: list[float]
    scales: list[float]
    model: Fitted | None
    threshold: float | None
    stats: dict = field(default_factory=dict)

    def standardised(self) -> list[str]:
        return [f"((`{f}` - {m!r}D) / {s!r}D)" for f, m, s in
                zip(self.features, self.means, self.scales, strict=True)]

    def probability(self, coefficients, intercept: float) -> str:
        terms = [f"{c!r}D * {z}" for c, z in zip(map(float, coefficients), self.standardised(), strict=True)]
        return f"1D / (1D + exp(-({' + '.join([*terms, f'{float(intercept)!r}D'])})))"


def newton_sums(df: DataFrame, model: RiskModel, label: str, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the log loss (without the penalty) at ``w``, the intercept last."""
    k = len(model.features)
    rows = df.selectExpr(*[f"{z} AS z{i}" for i, z in enumerate(model.standardised())], f"1D AS z{k}",
                         f"{model.probability(w[:-1], w[-1])} AS p", f"CAST({label} AS DOUBLE) AS y")
    rows = rows.selectExpr(*[f"z{i}" for i in range(k + 1)], "p - y AS e", "p * (1D - p) AS v")
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    got = rows.selectExpr(*[f"sum(e * z{i})" for i in range(k + 1)],
                          *[f"sum(v * z{i} * z{j})" for i, j in pairs]).first()
    gradient, hessian = np.array(got[:k + 1]), np.zeros((k + 1, k + 1))
    for (i, j), x in zip(pairs, got[k + 1:], strict=True):
        hessian[i, j] = hessian[j, i] = x
    return gradient, hessian


def train_risk_model(df: DataFrame, features: list[str], quantile: float = K.QUADRANT_QUANTILE,
                     max_steps: int = MAX_STEPS) -> RiskModel:
    """Label, standardise (population std) and fit. ``df`` is read once for the threshold's
    quantile, once for the scales, and once a step: give it materialised."""
    threshold = quantiles(df, [("t", "final_score", quantile)]).first()["t"]
    label = f"(final_score > {threshold!r}D)" if threshold is not None else "false"
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(F.expr(label)).alias("pos")]
    for i, f in enumerate(features):
        aggs += [F.avg(f).alias(f"m{i}"), F.stddev_pop(f).alias(f"s{i}")]
    st = df.agg(*aggs).first()
    n, pos = int(st["n"]), int(st["pos"])
    model = RiskModel(
        features, [float(st[f"m{i}"] or 0.0) for i in range(len(features))],
        [float(st[f"s{i}"] or 1.0) for i in range(len(features))], None, threshold,
        {"high_risk_count": pos, "low_risk_count": n - pos, "model_threshold": threshold,
         "quantile_used": quantile, "num_features": len(features), "samples_trained": n})
    if pos in (0, n):  # labels of one class only
        return model
    w = np.zeros(len(features) + 1)
    penalty = np.array([1.0] * len(features) + [0.0])
    for step in range(1, max_steps + 1):
        gradient, hessian = newton_sums(df, model, label, w)
        d = np.linalg.solve(hessian + np.diag(penalty), gradient + penalty * w)
        d *= min(1.0, STEP_CAP / max(float(np.abs(d).max()), 1e-300))
        w = w - d
        if np.abs(d).max() <= TOLERANCE:
            break
    model.model = Fitted([float(x) for x in w[:-1]], float(w[-1]), step)
    return model


def predict_risk(model: RiskModel, df: DataFrame) -> DataFrame:
    """risk_probability, high_risk_predicted (p > .5), risk_category; defaults
    0 / 0 / Low when no model could be fitted."""
    if model.model is None:
        return _no_predictions(df)
    p = F.expr(model.probability(model.model.coefficients, model.model.intercept))
    return df.withColumn("risk_probability", p).withColumns({
        "high_risk_predicted": (F.col("risk_probability") > 0.5).cast("int"),
        "risk_category": C.risk_category("risk_probability")})


def training_stats(model: RiskModel, df: DataFrame) -> DataFrame:
    """One row: training accuracy plus the counts kept at fit time."""
    s = model.stats
    if model.model is None:
        base = df.limit(1).select(F.lit(None).cast("double").alias("training_accuracy"))
    else:
        high = F.coalesce((F.col("final_score") > F.lit(model.threshold)).cast("int"), F.lit(0))
        base = predict_risk(model, df).agg(
            F.avg((F.col("high_risk_predicted") == high).cast("double")).alias("training_accuracy"))
    return base.select("training_accuracy",
                       F.lit(s["high_risk_count"]).cast("long").alias("high_risk_count"),
                       F.lit(s["low_risk_count"]).cast("long").alias("low_risk_count"),
                       F.lit(s["model_threshold"]).cast("double").alias("model_threshold"),
                       F.lit(s["quantile_used"]).cast("double").alias("quantile_used"),
                       F.lit(s["num_features"]).cast("int").alias("num_features"),
                       F.lit(s["samples_trained"]).cast("long").alias("samples_trained"))


def model_table(model: RiskModel, spark) -> DataFrame:
    """A row for each feature (mean, scale, coefficient) and one for the intercept."""
    coefs = model.model.coefficients if model.model is not None else [0.0] * len(model.features)
    rows = list(zip(model.features, model.means, model.scales, coefs, strict=True))
    rows.append(("(intercept)", 0.0, 1.0, model.model.intercept if model.model is not None else 0.0))
    return spark.createDataFrame(rows, "feature string, mean double, scale double, coefficient double")


def feature_importance(model: RiskModel, spark) -> DataFrame:
    """Coefficient per feature and its absolute value, largest first."""
    coefs = model.model.coefficients if model.model is not None else [0.0] * len(model.features)
    rows = [(f, c, abs(c)) for f, c in zip(model.features, coefs, strict=True)]
    df = spark.createDataFrame(rows, "feature string, coefficient double, abs_coefficient double")
    return df.orderBy(F.col("abs_coefficient").desc(), "feature")


def apply_ml_predictions(products: DataFrame, checkpoint: bool = True
                         ) -> tuple[DataFrame, RiskModel | None]:
    """features -> labels -> fit -> predict, on one frame that keeps the products' columns.

    Two cases degrade to 0 / 0 / Low for every product, as in the reference: critical columns
    that are missing, and labels of one class only. Any other error is raised.

    Fitting makes several passes over the product table (threshold, scales, one a step);
    ``checkpoint`` writes the features once to the shared folder, so that no pass recomputes
    the review pipeline."""
    products = products.drop(*PREDICTIONS)
    try:  # features replace some columns by cleaned ones: the products' own ride along
        feats_df, feats = ml_features(products.select(
            "*", *[F.col(f"`{c}`").alias(f"__own_{c}") for c in products.columns]))
    except MissingColumns:
        return _no_predictions(products), None
    if checkpoint:
        feats_df = written(feats_df, "features")
    model = train_risk_model(feats_df, feats)
    return predict_risk(model, feats_df).select(
        *[F.col(f"`__own_{c}`").alias(c) for c in products.columns], *PREDICTIONS), model


def _no_predictions(df: DataFrame) -> DataFrame:
    return df.withColumns({"risk_probability": F.lit(0.0), "high_risk_predicted": F.lit(0),
                           "risk_category": F.lit("Low")})
