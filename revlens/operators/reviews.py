"""Review-level operators: schema profiles, scorer preparation, scoring.

Column-name resolution happens on the driver over ``df.columns`` (schema only,
no data); every data change is a single ``select`` of JVM expressions.
Global min/max statistics are observed while the scorer's input is written once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.functions import columns as C
from revlens.functions import constants as K
from revlens.functions.stats import observed_minmax

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)


def _has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def _replace(df: DataFrame, exprs: dict) -> DataFrame:
    """Replace/append columns in one projection, keeping column order."""
    out = [exprs[c].alias(c) if c in exprs else F.col(f"`{c}`") for c in df.columns]
    out += [e.alias(n) for n, e in exprs.items() if n not in df.columns]
    return df.select(*out)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


# ---- dashboard profile --------------------------------------------------------
def normalize_reviews(df: DataFrame) -> DataFrame:
    """Dashboard profile: standard column kept if present, else the first alias
    present (copied), else default 0; product trimmed, blanks dropped; numeric
    columns coerced (unparsable -> 0); flags -> 0/1 ints. Missing review text
    becomes '' (a 0 would break text matching)."""
    exprs = {}
    for std, aliases in K.DASHBOARD_ALIASES.items():
        if _has(df, std):
            continue
        src = next((a for a in aliases if _has(df, a)), None)
        if src is not None:
            exprs[std] = F.col(f"`{src}`")
        elif std == "review_text":
            exprs[std] = F.lit("")
        elif std in ("product", "sentiment"):
            exprs[std] = F.lit("0")
        else:
            exprs[std] = F.lit(0)
    cur = {c: F.col(f"`{c}`") for c in df.columns}
    cur.update(exprs)
    fixed = dict(exprs)
    fixed["product"] = C.strip_ws(F.coalesce(cur["product"].cast("string"), F.lit("Unknown")))
    for c in ["rating", "sentiment_score", "customer_ltv", "order_value",
              "days_since_purchase", "helpful_votes"]:
        fixed[c] = F.coalesce(C.to_double(cur[c]), F.lit(0.0))
    for c in ["is_repeat_customer", "verified_purchase"]:
        src = c if _has(df, c) else next((a for a in K.DASHBOARD_ALIASES[c] if _has(df, a)), None)
        fixed[c] = C.flag_to_int(cur[c], df.schema[src].dataType if src else T.IntegerType())
    if "review_text" not in exprs:
        fixed["review_text"] = cur["review_text"].cast("string")
    return _replace(df, fixed).filter(F.col("product") != "")


# ---- service profile ----------------------------------------------------------
def _find_ci(df: DataFrame, names: list[str]) -> str | None:
    lower = {c.lower(): c for c in df.columns}
    for n in names:
        if n in df.columns:
            return n
    for n in names:
        if n.lower() in lower:
            return lower[n.lower()]
    return None


def normalize_reviews_service(df: DataFrame, now_iso: str | None = None) -> DataFrame:
    """Service profile: product/rating aliases renamed (case-insensitive), any
    column containing 'product' as a last resort; defaults rating 3, LTV 1000,
    days 30, verified True (no ``ltv`` alias)."""
    d = K.SERVICE_DEFAULTS
    if not _has(df, "product"):
        src = _find_ci(df, K.SERVICE_PRODUCT_ALIASES) or next(
            (c for c in df.columns if "product" in c.lower()), None)
        df = df.withColumnRenamed(src, "product") if src else df.withColumn(
            "product", F.lit(d["product"]))
    if not _has(df, "rating"):
        src = _find_ci(df, ["rating"] + K.SERVICE_RATING_ALIASES)
        df = df.withColumnRenamed(src, "rating") if src else df.withColumn(
            "rating", F.lit(d["rating"]))
    adds = {}
    if not _has(df, "review_date"):
        adds["review_date"] = (F.lit(now_iso) if now_iso else
                               F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"))
    for c in ["review_text", "customer_ltv", "order_value", "helpful_votes",
              "days_since_purchase", "is_repeat_customer", "verified_purchase"]:
        if not _has(df, c):
            adds[c] = F.lit(d[c])
    cur = {c: F.col(f"`{c}`") for c in df.columns}
    cur.update(adds)
    fixed = dict(adds)
    for c in ["rating", "customer_ltv", "order_value", "helpful_votes", "days_since_purchase"]:
        fixed[c] = F.coalesce(C.to_double(cur[c]), F.lit(float(d[c])))
    fixed["product"] = F.coalesce(cur["product"].cast("string"), F.lit(d["product"]))
    fixed["review_text"] = F.coalesce(cur["review_text"].cast("string"), F.lit(""))
    fixed["is_repeat_customer"] = F.coalesce(cur["is_repeat_customer"].cast("string").try_cast("boolean"),
                                             F.lit(False))
    fixed["verified_purchase"] = F.coalesce(cur["verified_purchase"].cast("string").try_cast("boolean"),
                                            F.lit(True))
    return _replace(df, fixed)


def check_required_columns(df: DataFrame) -> tuple[bool, str]:
    """Alias-aware, case-insensitive presence of product and rating (schema only)."""
    lower = {c.lower() for c in df.columns}
    missing = [req for req, aliases in K.REQUIRED_ALIASES.items()
               if not any(a.lower() in lower for a in aliases)]
    if missing:
        return False, f"Missing required columns: {', '.join(missing)}"
    return True, "Schema valid"


def fetch_column_repair(df: DataFrame) -> DataFrame:
    """Paged-source repair: missing required columns -> null, product null/missing
    -> 'General', trimmed, blanks dropped; LTV coerced (unparsable -> 0)."""
    required = ["rating", "review_text", "customer_ltv", "order_value", "days_since_purchase",
                "helpful_votes", "is_repeat_customer", "verified_purchase"]
    adds = {c: F.lit(None).cast("string") for c in required if not _has(df, c)}
    if not _has(df, "product"):
        adds["product"] = F.lit("General")
    cur = {c: F.col(f"`{c}`") for c in df.columns}
    cur.update(adds)
    fixed = dict(adds)
    fixed["product"] = C.strip_ws(F.coalesce(cur["product"].cast("string"), F.lit("General")))
    fixed["customer_ltv"] = F.coalesce(C.to_double(cur["customer_ltv"]), F.lit(0.0))
    return _replace(df, fixed).filter(F.col("product") != "")


# ---- scorer -------------------------------------------------------------------
def _scorer_input(df: DataFrame) -> DataFrame:
    """Scorer defaults: numbers coerced and filled, columns that are missing created."""
    fixed = {}
    for c, dflt in (("customer_ltv", 0.0), ("order_value", 0.0), ("helpful_votes", 0.0),
                    ("days_since_purchase", 30.0)):
        fixed[c] = F.coalesce(C.to_double(f"`{c}`"), F.lit(dflt)) if _has(df, c) else F.lit(dflt)
    fixed["rating"] = C.to_double("rating") if _has(df, "rating") else F.lit(3.0)
    fixed["review_text"] = (F.col("review_text").cast("string") if _has(df, "review_text") else F.lit(""))
    for c in ["is_repeat_customer", "verified_purchase"]:
        if not _has(df, c):
            fixed[c] = F.lit(False)
    return _replace(df, fixed)


def _flags(df: DataFrame) -> list[Column]:
    return [C.flag_to_int(c, df.schema[c].dataType).alias(name)
            for c, name in (("is_repeat_customer", "repeat"), ("verified_purchase", "verified"))]


def prepare_reviews(df: DataFrame) -> DataFrame:
    """Scorer defaults, log scaling, min-max (constant -> 0), flags, rating clip.

    The input (joins and all) is read once: it is written to the shared folder while the three
    minima and maxima are observed, and scaled from there."""
    df = _scorer_input(df)
    logs = {"ltv_log": C.log_scale("customer_ltv"), "order_value_log": C.log_scale("order_value")}
    df, bounds = observed_minmax(df, {"ltv": logs["ltv_log"], "order": logs["order_value_log"],
                                      "helpful": "helpful_votes"})
    own = df.columns
    df = df.select("*", *[e.alias(n) for n, e in logs.items()])
    return df.select(
        *[F.col(f"`{c}`") for c in [*own, *logs] if c != "rating"],
        C.minmax_eps_const0("ltv_log", *bounds["ltv"]).alias("ltv_norm"),
        C.minmax_eps_const0("order_value_log", *bounds["order"]).alias("order_norm"),
        C.minmax_eps_const0("helpful_votes", *bounds["helpful"]).alias("helpful_norm"),
        *_flags(df), C.clip("rating", 1.0, 5.0).alias("rating"))


def rate_reviews(df: DataFrame, use_sentiment: bool = False) -> DataFrame:
    """What the scorer says of a review by itself: flags, recency, severity and category. Lazy
    and without statistics of the whole set, for consumers that need no importance."""
    df = _scorer_input(df)
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c != "rating"], *_flags(df),
                   C.clip("rating", 1.0, 5.0).alias("rating"))
    return _zero_nulls(_rated(df, use_sentiment)).select("*", _category(df))


def _rated(df: DataFrame, use_sentiment: bool) -> DataFrame:
    sentiment = "sentiment" if use_sentiment and _has(df, "sentiment") else None
    return df.select("*", C.is_negative("rating").alias("is_negative"),
                     C.recency_plateau("days_since_purchase").alias("recency_score"),
                     C.issue_severity("rating", sentiment).alias("issue_severity"))


def _category(df: DataFrame) -> Column:
    cat = C.issue_category("review_text") if _has(df, "review_text") else F.lit(K.ISSUE_OTHER)
    return cat.alias("issue_category")


def _zero_nulls(df: DataFrame) -> DataFrame:
    """Numeric columns: null and NaN -> 0."""
    out = []
    for f in df.schema.fields:
        x = F.col(f"`{f.name}`")
        if isinstance(f.dataType, NUMERIC_TYPES):
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
                x = C.nan_to_null(x)
            x = F.coalesce(x, F.lit(0)).cast(f.dataType).alias(f.name)
        out.append(x)
    return df.select(*out)


def numeric_null_to_zero(df: DataFrame) -> DataFrame:
    """All numeric columns: NaN/null -> 0; strings untouched."""
    nums = numeric_columns(df)
    return df.na.fill(0, subset=nums) if nums else df


def score_reviews(df: DataFrame, use_sentiment: bool = False) -> DataFrame:
    """prepare -> is_negative -> recency -> severity -> CIS -> impact -> category
    -> numeric null sweep. Severity uses a neutral sentiment unless asked."""
    df = _rated(prepare_reviews(df), use_sentiment)
    df = _zero_nulls(df.select("*", C.customer_importance().alias("CIS")))
    return df.select("*", F.coalesce(C.impact_score(), F.lit(0.0)).alias("impact_score"), _category(df))


def column_bounds(df: DataFrame) -> tuple[DataFrame, dict[str, tuple[Column, Column]]]:
    """``df`` written once to the shared folder, and (minimum, maximum) of every column as a
    number, observed on the way: bounds for any number of ``minmax_column`` calls."""
    return observed_minmax(df, {c: C.to_double(F.col(f"`{c}`")) for c in df.columns})


def minmax_column(df: DataFrame, col: str, out: str, variant: str = "const0",
                  clip_result: bool = False, bounds: tuple[Column, Column] | None = None) -> DataFrame:
    """Min-max scale one column over the whole frame. ``bounds``: its (minimum, maximum), as
    ``column_bounds`` gives them; without them ``df`` is written once while they are observed,
    so its input is read once either way.
    ``const0``: scorer variant; ``safe``: 0.5 when constant; ``eps``: classic."""
    x = C.to_double(F.col(col))
    if bounds is None:
        df, found = observed_minmax(df, {"x": x})
        bounds = found["x"]
    if variant == "const0":
        e = C.minmax_eps_const0(x, *bounds)
    elif variant == "safe":
        e = C.minmax_safe(x, *bounds)
    else:
        e = C.minmax_eps(x, *bounds, clip_result=clip_result)
    return df.select(*[F.col(f"`{c}`") for c in df.columns], e.alias(out))
