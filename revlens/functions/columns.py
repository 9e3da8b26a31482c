"""Column-level building blocks (Column -> Column), all JVM-side expressions.

pandas semantics kept on purpose:
* ``clip`` keeps missing values (``greatest/least`` would turn null into a bound);
* NaN is treated as missing, so numeric inputs are NaN-cleaned before use;
* ``ln(1+x)`` is null for x <= -1 (pandas gives -inf/NaN, which the
  pipelines sweep to 0 later).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.functions import constants as K


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    """NaN -> null. The argument is named once: a filter that is pushed below a projection puts
    the whole expression in place of every mention, and chains of such functions would multiply."""
    return F.nanvl(col_(c), F.lit(None).cast("double"))


def clip(c, lo: float | None = None, hi: float | None = None) -> Column:
    """Null-preserving clip."""
    c = col_(c)
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(c.isNotNull(), out)


def clip01(c) -> Column:
    return clip(c, 0.0, 1.0)


def to_double(c) -> Column:
    """Lenient numeric coercion (``to_numeric(errors='coerce')``); NaN -> null."""
    return nan_to_null(col_(c).try_cast("double"))


def strip_ws(c) -> Column:
    """Python ``str.strip()``: trims every kind of leading/trailing whitespace."""
    return F.regexp_replace(col_(c), r"^\s+|\s+$", "")


def log_scale(c) -> Column:
    """``ln(1 + x)``; null for x <= -1."""
    c = col_(c)
    return F.when(c > -1.0, F.log1p(c))


def safe_ratio(num, den, default: float = 0.0) -> Column:
    """``num / den`` with a default on a zero/null divisor."""
    return F.coalesce(F.try_divide(col_(num).cast("double"), col_(den).cast("double")),
                      F.lit(default))


# ---- min-max variants: the statistics come in as columns ------------------
def minmax_eps_const0(x, mn, mx) -> Column:
    """Scorer variant: 0.0 when the column is constant, else clipped eps-scaled."""
    x, mn, mx = col_(x), col_(mn), col_(mx)
    return F.when(mx == mn, F.lit(0.0)).otherwise(
        clip01((x - mn) / (mx - mn + K.MINMAX_EPS)))


def minmax_safe(x, mn, mx) -> Column:
    """Robust variant: 0.5 when min and max are close (numpy ``isclose``)."""
    x, mn, mx = col_(x), col_(mn), col_(mx)
    close = F.abs(mn - mx) <= (1e-8 + 1e-5 * F.abs(mx))
    return F.when(close, F.lit(0.5)).otherwise((x - mn) / (mx - mn))


def minmax_eps(x, mn, mx, clip_result: bool = False) -> Column:
    """Classic variant: epsilon only (constant -> 0); product variant also clips."""
    x, mn, mx = col_(x), col_(mn), col_(mx)
    out = (x - mn) / (mx - mn + K.MINMAX_EPS)
    return clip01(out) if clip_result else out


# ---- scalar features ---------------------------------------------------------
def recency_plateau(days) -> Column:
    d = col_(days)
    adj = F.when(d - K.RECENCY_PLATEAU_DAYS > 0, d - K.RECENCY_PLATEAU_DAYS).when(
        d.isNotNull(), F.lit(0.0))
    return clip01(F.exp(-adj / K.RECENCY_DECAY_DAYS))


def recency_decay(days) -> Column:
    return clip01(F.exp(-col_(days) / K.RECENCY_DECAY_DAYS))


def severity_rating(rating) -> Column:
    return clip01((F.lit(5.0) - col_(rating)) / 4.0)


def sentiment_lookup(sentiment, mapping: dict, default: float = K.SENTIMENT_DEFAULT) -> Column:
    s = col_(sentiment)
    out = None
    for k, v in mapping.items():
        out = (F.when(s == k, F.lit(v)) if out is None else out.when(s == k, F.lit(v)))
    return out.otherwise(F.lit(default))


def sentiment_to_score(sentiment) -> Column:
    return clip01(sentiment_lookup(sentiment, K.SENTIMENT_SCORE))


def issue_severity(rating, sentiment=None, literal: str = "neutral") -> Column:
    """``0.6*clip((5-r)/4) + 0.4*s``. With no sentiment column the literal is used
    (lower-cased); a column is matched case-sensitively, unmapped -> 0.5."""
    if sentiment is None:
        s = F.lit(K.SENTIMENT_SEVERITY.get(literal.lower(), K.SENTIMENT_DEFAULT))
    else:
        s = sentiment_lookup(sentiment, K.SENTIMENT_SEVERITY)
    return clip01(K.SEVERITY_RATING_WEIGHT * severity_rating(rating)
                  + K.SEVERITY_SENTIMENT_WEIGHT * s)


def flag_to_int(c, dtype: T.DataType | None = None) -> Column:
    """Booleans (also as text) -> 0/1 int, numbers (also as text) -> their integer part;
    null and anything else -> 0 (a dirty value must not end the job; ``bad_flag`` marks them).
    ``dtype``, where known, picks the one conversion that applies."""
    c = col_(c)
    if isinstance(dtype, T.BooleanType):
        return F.coalesce(c.cast("int"), F.lit(0))
    if isinstance(dtype, T.NumericType):
        return F.coalesce(c.try_cast("int"), F.lit(0))
    text = c.cast("string")  # 1 and 0 are booleans too, so most numbers need no second try
    return F.coalesce(text.try_cast("boolean").cast("int"), text.try_cast("double").try_cast("int"), F.lit(0))


def bad_flag(c) -> Column:
    """A value that is neither a boolean nor a number."""
    text = col_(c).cast("string")
    return text.isNotNull() & text.try_cast("double").isNull() & text.try_cast("boolean").isNull()


def is_negative(rating, max_rating: float = K.NEGATIVE_FLAG_MAX_RATING) -> Column:
    return F.coalesce((col_(rating) <= max_rating).cast("int"), F.lit(0))


def customer_importance(ltv_norm="ltv_norm", order_norm="order_norm", repeat="repeat",
                        verified="verified", helpful_norm="helpful_norm",
                        recency="recency_score") -> Column:
    w = K.CIS_WEIGHTS
    return clip01(w["ltv_norm"] * col_(ltv_norm) + w["order_norm"] * col_(order_norm)
                  + w["repeat"] * col_(repeat) + w["verified"] * col_(verified)
                  + w["helpful_norm"] * col_(helpful_norm) + w["recency_score"] * col_(recency))


def impact_score(cis="CIS", severity="issue_severity", rating="rating") -> Column:
    """CIS x severity, zero unless rating <= 3, clipped."""
    return clip01(F.when(col_(rating) <= K.IMPACT_GATE_MAX_RATING,
                         col_(cis) * col_(severity)).otherwise(F.lit(0.0)))


def keyword_pattern(words) -> str:
    return "|".join(words)


def issue_category(text) -> Column:
    """Case-folded substring match in priority order; null text -> Other."""
    t = F.lower(F.coalesce(col_(text).cast("string"), F.lit("")))
    out = None
    for name, words in K.ISSUE_KEYWORDS:
        cond = t.rlike(keyword_pattern(words))
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.otherwise(F.lit(K.ISSUE_OTHER))


def band3(p, cuts, labels=("Low", "Medium", "High"), inclusive_upper: bool = False,
          null_label: str | None = "Low") -> Column:
    """Three-way banding. ``inclusive_upper`` gives (lo, hi] bins (pd.cut style),
    otherwise >= thresholds."""
    p = col_(p)
    lo, hi = cuts
    if inclusive_upper:
        out = F.when(p <= lo, labels[0]).when(p <= hi, labels[1]).when(p.isNotNull(), labels[2])
    else:
        out = F.when(p >= hi, labels[2]).when(p >= lo, labels[1]).when(p.isNotNull(), labels[0])
    return out.otherwise(F.lit(null_label)) if null_label is not None else out


def risk_category(p) -> Column:
    """[0,.3] Low, (.3,.7] Medium, (.7,1] High; null/out of range -> Low."""
    p = col_(p)
    lo, hi = K.RISK_CUTS_MODEL
    return (F.when((p >= 0) & (p <= lo), "Low").when((p > lo) & (p <= hi), "Medium")
            .when((p > hi) & (p <= 1), "High").otherwise("Low"))


def risk_band(p, preset: str = "chart") -> Column:
    cuts = K.RISK_BANDS_CHART if preset == "chart" else K.RISK_BANDS_CLIENT
    return band3(p, cuts, null_label=None)


def severity_band(norm_score) -> Column:
    return band3(norm_score, K.SEVERITY_BANDS, null_label=None)


def impact_pct(revenue) -> Column:
    """``min(100, int(rar / 100000 * 100))`` (truncation toward zero)."""
    v = (col_(revenue) / K.IMPACT_PCT_REVENUE_SCALE * 100.0).cast("long")
    return F.least(F.lit(100).cast("long"), v)


def issue_split(total_reviews) -> Column:
    n = col_(total_reviews).cast("double")
    return F.struct(*[(n * share).cast("long").alias(name) for name, share in K.ISSUE_SPLIT])


def nested_get(json_col, path: str, default=None) -> Column:
    """Path lookup with a default: ``$.a.b`` style on a JSON string column."""
    got = F.get_json_object(col_(json_col), "$." + path.lstrip("$."))
    return F.coalesce(got, F.lit(default)) if default is not None else got


def round_even(c, d: int) -> Column:
    """Python ``round`` (half to even)."""
    return F.bround(col_(c), d)


MONEY = "decimal(38,6)"


def money_sum(c) -> Column:
    """Exact sum of amounts (six decimals), as a double: no order of summation can change it, so
    what is cut or rounded afterwards is the same on every run. Values that are no numbers
    count as missing."""
    return F.sum(col_(c).try_cast(MONEY)).cast("double")


def money_avg(c) -> Column:
    """Exact sum over the count of values."""
    amount = col_(c).try_cast(MONEY)
    return F.try_divide(F.sum(amount).cast("double"), F.count(amount).cast("double"))


def round6(c) -> Column:
    """Six places in two steps, half to even: the first drops what a sum's order leaves."""
    return F.rint(F.rint(col_(c) * 1e9) / 1e3) / 1e6


def trunc_money(c) -> Column:
    """``int(x)`` of an exact amount."""
    return col_(c).cast("long")
