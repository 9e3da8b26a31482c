"""Schema enforcement, missing-value handling and data-quality reports.

Reports are tidy DataFrames, not nested dicts: every check becomes rows
``(check, column, severity, n, message)``. Data-dependent counts come from one
aggregate per report (``count_if`` per column), stacked into rows; schema
facts (missing columns, types) are read from ``df.schema`` on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.functions import columns as C
from revlens.functions import constants as K
from revlens.functions.stats import observed_minmax
from revlens.operators.gate import Checked, DataError, check_rows, output_constraints, types_match
from revlens.operators.reviews import NUMERIC_TYPES, numeric_columns

REPORT_SCHEMA = "check string, column string, severity string, n bigint, message string"


def assert_columns(df: DataFrame, required: list[str], context: str = "") -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise DataError(f"{context + ': ' if context else ''}missing columns {missing}")
    return df


def assert_not_empty(df: DataFrame, context: str = "") -> DataFrame:
    """Raises on empty input; one short job (``isEmpty`` stops at the first row)."""
    if df.isEmpty():
        raise DataError(f"{context + ': ' if context else ''}no rows")
    return df


def _null_or_nan(c: str, dtype) -> F.Column:
    col = F.col(f"`{c}`")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def _stack(df_one_row: DataFrame, items: list[tuple[str, str]], key: str, val: str) -> DataFrame:
    """One-row frame with columns -> rows ``(key, val)`` via ``stack``."""
    if not items:
        return df_one_row.sparkSession.createDataFrame([], f"{key} string, {val} bigint")
    args = ", ".join(f"'{name}', `{colname}`" for name, colname in items)
    return df_one_row.selectExpr(f"stack({len(items)}, {args}) as ({key}, {val})")


# ---- robust profile ------------------------------------------------------------
def enforce_schema(df: DataFrame, strict: bool = False) -> DataFrame:
    """Create missing expected columns with their defaults (strict mode: leave
    them out and report instead); coerce float / int (truncating) / str with the
    default on failure."""
    exprs = {}
    for c, kind in K.ROBUST_SCHEMA.items():
        dflt = K.ROBUST_DEFAULTS[c]
        if c not in df.columns:
            if strict:
                continue
            src = F.lit(dflt)
        else:
            src = F.col(f"`{c}`")
        if kind == "float":
            exprs[c] = F.coalesce(C.to_double(src), F.lit(float(dflt)))
        elif kind == "int":
            exprs[c] = F.coalesce(C.to_double(src), F.lit(float(dflt))).cast("int")
        else:
            exprs[c] = F.coalesce(src.cast("string"), F.lit(dflt))
    out = [exprs[c].alias(c) if c in exprs else F.col(f"`{c}`") for c in df.columns]
    out += [e.alias(n) for n, e in exprs.items() if n not in df.columns]
    return df.select(*out)


def schema_report(df: DataFrame, strict: bool = False) -> DataFrame:
    """Rows for missing / filled columns and for values that failed coercion
    (counted before filling)."""
    spark = df.sparkSession
    rows = []
    for c in K.ROBUST_SCHEMA:
        if c not in df.columns:
            rows.append(("missing_column" if strict else "filled_column", c,
                         "critical" if strict else "info", 0,
                         f"{'Missing required' if strict else 'Created missing'} column: {c}"))
    static = spark.createDataFrame(rows, REPORT_SCHEMA)
    present = [c for c in K.ROBUST_SCHEMA if c in df.columns]
    if not present:
        return static
    aggs = []
    for c in present:
        kind = K.ROBUST_SCHEMA[c]
        v = F.col(f"`{c}`")
        bad = v.isNull() if kind == "str" else C.to_double(v).isNull()
        aggs.append(F.count_if(bad).alias(f"bad_{c}"))
    counts = _stack(df.agg(*aggs), [(c, f"bad_{c}") for c in present], "column", "n")
    conv = counts.select(F.lit("type_conversion").alias("check"), "column",
                         F.lit("info").alias("severity"), "n",
                         F.format_string("%s: filled %d values with default", F.col("column"),
                                         F.col("n")).alias("message"))
    return static.unionByName(conv.filter(F.col("n") > 0))


def fill_missing(df: DataFrame) -> DataFrame:
    """Nulls (and NaN) -> domain default for every known column present."""
    vals = {c: v for c, v in K.ROBUST_DEFAULTS.items() if c in df.columns}
    return df.na.fill(vals) if vals else df


def fill_report(df: DataFrame) -> DataFrame:
    """Per-column filled counts plus before/after totals, one aggregate."""
    types = {f.name: f.dataType for f in df.schema.fields}
    known = [c for c in K.ROBUST_DEFAULTS if c in df.columns]
    aggs = [F.count_if(_null_or_nan(c, types[c])).alias(f"f_{c}") for c in known]
    total_before = None
    for c in df.columns:
        term = F.count_if(_null_or_nan(c, types[c]))
        total_before = term if total_before is None else total_before + term
    other = [c for c in df.columns if c not in known]
    total_after = F.lit(0).cast("bigint")
    for c in other:
        total_after = total_after + F.count_if(_null_or_nan(c, types[c]))
    aggs += [total_before.alias("nan_count_before"), total_after.alias("nan_count_after")]
    one = df.agg(*aggs)
    items = [(c, f"f_{c}") for c in known] + [("__before", "nan_count_before"),
                                               ("__after", "nan_count_after")]
    return _stack(one, items, "column", "n")


def final_null_sweep(df: DataFrame) -> DataFrame:
    """Any column still null -> its default, else 0 (numeric) / '0' (text)."""
    known = {c: v for c, v in K.ROBUST_DEFAULTS.items() if c in df.columns}
    out = df.na.fill(known) if known else df
    nums = [c for c in numeric_columns(out) if c not in known]
    if nums:
        out = out.na.fill(0, subset=nums)
    strs = [f.name for f in out.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in known]
    return out.na.fill("0", subset=strs) if strs else out


def clip_ranges(df: DataFrame) -> DataFrame:
    """rating -> [1, 5], sentiment_score -> [0, 1]; nulls kept."""
    ex = {c: C.clip(c, lo, hi) for c, (lo, hi) in K.ROBUST_RANGES.items() if c in df.columns}
    return df.withColumns(ex) if ex else df


TOTAL = "(total)"


def null_profile(df: DataFrame, critical: list[str] | None = None) -> DataFrame:
    """Per column with missing values: count, percentage of rows, critical flag; and a row
    ``(total)`` with the missing values of all columns, their share of all values, and whether
    a critical column has any."""
    critical = list(K.ROBUST_SCHEMA) if critical is None else critical
    types = {f.name: f.dataType for f in df.schema.fields}
    aggs = [F.count(F.lit(1)).alias("__rows")] + [
        F.count_if(_null_or_nan(c, types[c])).alias(f"n_{i}") for i, c in enumerate(df.columns)]
    one = df.agg(*aggs)
    n = [f"`n_{i}`" for i in range(len(df.columns))]
    flags = [str(c in critical).lower() for c in df.columns]
    args = ", ".join(f"'{c}', {x}, __rows, {flag}" for c, x, flag in zip(df.columns, n, flags, strict=True))
    any_critical = " OR ".join(f"{x} > 0" for x, flag in zip(n, flags, strict=True) if flag == "true") or "false"
    args += f", '{TOTAL}', {' + '.join(n) or '0L'}, __rows * {len(n)}, ({any_critical})"
    long = one.selectExpr(f"stack({len(df.columns) + 1}, {args}) as (column, null_count, of, critical)")
    return long.filter((F.col("null_count") > 0) | (F.col("column") == TOTAL)).select(
        "column", "null_count",
        F.coalesce(F.try_divide(F.col("null_count") * 100.0, F.col("of")), F.lit(0.0)).alias("null_pct"), "critical")


def sanity_checks(df: DataFrame) -> DataFrame:
    """Issue rows: empty input, missing required columns, missing values in
    critical columns, out-of-range values, and dtype mismatches. The data is
    valid when no row has severity 'critical'."""
    spark = df.sparkSession
    types = {f.name: f.dataType for f in df.schema.fields}
    static = []
    missing = [c for c in K.ROBUST_SCHEMA if c not in df.columns]
    for c in missing:
        static.append(("missing_column", c, "critical", 0, f"Missing column: {c}"))
    for c, kind in K.ROBUST_SCHEMA.items():
        if c not in types:
            continue
        dt = types[c]
        ok = {"float": isinstance(dt, NUMERIC_TYPES),
              "int": isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)),
              "str": isinstance(dt, T.StringType)}[kind]
        if not ok:
            label = {"float": "numeric", "int": "integer", "str": "string"}[kind]
            static.append(("dtype", c, "warning", 0, f"Column '{c}' is not {label}"))
    present = [c for c in K.ROBUST_SCHEMA if c in types]
    aggs = [F.count(F.lit(1)).alias("__rows")]
    aggs += [F.count_if(_null_or_nan(c, types[c])).alias(f"nan_{c}") for c in present]
    ranged = [c for c in K.ROBUST_RANGES if c in types and isinstance(types[c], NUMERIC_TYPES)]
    for c in ranged:
        lo, hi = K.ROBUST_RANGES[c]
        aggs.append(F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(f"rng_{c}"))
    one = df.agg(*aggs)
    parts = [spark.createDataFrame(static, REPORT_SCHEMA)]
    empty = one.select(F.lit("empty").alias("check"), F.lit(None).cast("string").alias("column"),
                       F.lit("critical").alias("severity"), F.col("__rows").alias("n"),
                       F.lit("Dataset is empty").alias("message")).filter(F.col("n") == 0)
    parts.append(empty)
    if present:
        nn = _stack(one, [(c, f"nan_{c}") for c in present], "column", "n")
        nn = nn.crossJoin(F.broadcast(one.select("__rows")))
        parts.append(nn.filter(F.col("n") > 0).select(
            F.lit("critical_nan").alias("check"), "column", F.lit("critical").alias("severity"),
            "n", F.concat(F.lit("Critical column '"), F.col("column"), F.lit("' has "),
                          F.col("n").cast("string"), F.lit(" NaN values ("),
                          F.format_number(F.col("n") / F.col("__rows") * 100.0, 1),
                          F.lit("%)")).alias("message")))
    if ranged:
        rg = _stack(one, [(c, f"rng_{c}") for c in ranged], "column", "n")
        parts.append(rg.filter(F.col("n") > 0).select(
            F.lit("range_clip").alias("check"), "column", F.lit("warning").alias("severity"), "n",
            F.concat(F.lit("Clipped "), F.col("n").cast("string"),
                     F.lit(" out-of-range values in '"), F.col("column"), F.lit("'"))
            .alias("message")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def is_valid(report: DataFrame) -> bool:
    """True when the report holds no critical row (one short job)."""
    return report.filter(F.col("severity") == "critical").isEmpty()


def robust_preprocess(df: DataFrame) -> DataFrame:
    """enforce -> fill -> log -> safe min-max (constant -> 0.5) -> flags ->
    (sanity clip) -> final sweep."""
    df = fill_missing(enforce_schema(df))
    df = df.withColumns({"customer_ltv": F.col("customer_ltv").cast("double"),
                         "order_value": F.col("order_value").cast("double")})
    df = df.withColumns({"ltv_log": C.log_scale("customer_ltv"),
                         "order_value_log": C.log_scale("order_value")})
    df, bounds = observed_minmax(df, {"ltv": "ltv_log", "order": "order_value_log",
                                      "helpful": F.col("helpful_votes").cast("double")})
    flags = {name: (C.flag_to_int(c, df.schema[c].dataType) if c in df.columns else F.col(name))
             for name, c in (("repeat", "is_repeat_customer"), ("verified", "verified_purchase"))}
    keep = [F.col(f"`{c}`") for c in df.columns if c not in flags]
    out = df.select(
        *keep,
        C.minmax_safe("ltv_log", *bounds["ltv"]).alias("ltv_norm"),
        C.minmax_safe("order_value_log", *bounds["order"]).alias("order_norm"),
        C.minmax_safe(F.col("helpful_votes").cast("double"), *bounds["helpful"]).alias("helpful_norm"),
        *[e.alias(n) for n, e in flags.items()])
    return final_null_sweep(clip_ranges(out))


def robust_pipeline(df: DataFrame) -> DataFrame:
    """robust_preprocess -> integrity (add missing schema columns, fill, cast)."""
    df = robust_preprocess(df)
    return final_null_sweep(enforce_schema(df))


def validate_output(df: DataFrame) -> DataFrame:
    """The output gate: four named checks and their verdict, a row each (check, ok, message)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    missing = [c for c in K.ROBUST_SCHEMA if c not in types]
    present = [c for c in K.ROBUST_SCHEMA if c in types]
    wrong = types_match(df)
    holes = F.array_compact(F.array(F.lit(None).cast("string"), *[
        F.when(F.count_if(_null_or_nan(c, types[c])) > 0, F.concat(
            F.lit(f"{c}: "), F.count_if(_null_or_nan(c, types[c])).cast("string"))) for c in present]))
    one = df.agg(F.count(F.lit(1)).alias("n"), F.concat_ws(", ", holes).alias("holes"))

    def row(name, ok, message):
        return F.struct(F.lit(name).alias("check"), ok.alias("ok"), message.alias("message"))

    n, nan = F.col("n") > 0, F.col("holes") == ""
    columns, dtypes = F.lit(not missing), F.lit(not wrong)
    return one.select(F.explode(F.array(
        row("non_empty", n, F.concat(F.col("n").cast("string"), F.lit(" rows"))),
        row("required_columns_present", columns, F.lit(", ".join(missing))),
        row("no_critical_nan", nan, F.col("holes")),
        row("correct_dtypes", dtypes, F.lit(", ".join(wrong))),
        row("valid", n & columns & nan & dtypes, F.lit("")))).alias("r")).select("r.*")


def preprocess_report(df: DataFrame) -> DataFrame:
    """What the robust pipeline does to ``df``, step by step: (step, check, column, severity, n, message)."""
    def step(name, report):
        return report.select(F.lit(name).alias("step"), "check", "column", "severity", "n", "message")

    enforced = enforce_schema(df)
    fills = fill_report(enforced).where("n > 0").select(
        F.lit("filled").alias("check"), "column", F.lit("info").alias("severity"), "n",
        F.concat(F.lit("Missing values: "), F.col("n").cast("string")).alias("message"))
    out = robust_pipeline(df)
    gate = validate_output(out).select(
        "check", F.lit(None).cast("string").alias("column"),
        F.when(F.col("ok"), "info").otherwise("critical").alias("severity"), F.lit(0).cast("bigint").alias("n"),
        "message")
    return (step("schema", schema_report(df)).union(step("fill", fills))
            .union(step("sanity", sanity_checks(out))).union(step("validation", gate)))


def robust_pipeline_checked(df: DataFrame) -> Checked:
    """``robust_pipeline`` behind its final validation: written once and checked on the way;
    raises ``DataError`` on a critical finding (no rows, a column missing, a hole)."""
    out = robust_pipeline(df)
    return check_rows(out, output_constraints(out)).raise_if_unusable(list(K.ROBUST_SCHEMA))


def robustness_report(df: DataFrame) -> DataFrame:
    """Shape, schema, sanity and null rows in one tidy frame."""
    shape = df.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("shape").alias("check"), F.lit("__rows").alias("column"),
        F.lit("info").alias("severity"), "n",
        F.format_string("%d rows x %d columns", F.col("n"), F.lit(len(df.columns)))
        .alias("message"))
    nulls = null_profile(df).select(
        F.lit("null_profile").alias("check"), "column",
        F.when(F.col("critical"), "critical").otherwise("info").alias("severity"),
        F.col("null_count").alias("n"),
        F.format_string("%.1f%% missing", F.col("null_pct")).alias("message"))
    return shape.unionByName(schema_report(df)).unionByName(sanity_checks(df)).unionByName(nulls)


def ingest_summary(df: DataFrame, failed_pages: DataFrame | None = None) -> DataFrame:
    """Rows, distinct products, LTV min/max/sum, and the number of failed pages (a row each in
    ``failed_pages``, as ``PageLanding.failed`` gives them; 0 for sources without pages). The
    product name list of the reference is left out: it grows with the catalogue; use
    ``distinct_products`` for a distributed, sorted list."""
    one = df.agg(
        F.count(F.lit(1)).alias("total_reviews"),
        F.count_distinct("product").alias("unique_products"),
        F.min("customer_ltv").alias("ltv_min"), F.max("customer_ltv").alias("ltv_max"),
        C.money_sum("customer_ltv").alias("ltv_sum"))
    if failed_pages is None:
        return one.withColumn("failed_pages", F.lit(0))
    return one.crossJoin(F.broadcast(failed_pages.agg(F.count(F.lit(1)).cast("int").alias("failed_pages"))))


def quality_overview(df: DataFrame) -> DataFrame:
    """Review count, distinct products, total LTV."""
    return df.agg(F.count(F.lit(1)).alias("total_reviews"),
                  F.count_distinct("product").alias("unique_products"),
                  F.coalesce(C.money_sum("customer_ltv"), F.lit(0.0)).alias("total_ltv"))
