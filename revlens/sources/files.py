"""File sources and sinks for reviews.

* CSV with a header: read as text columns (no schema inference, which would
  cost a full extra pass); pandas' missing-value tokens become null and the
  schema profiles coerce types with ``try_cast`` later.
* JSON in four shapes: a top-level array, ``{"data": [...]}``,
  ``{"records": [...]}`` and a single (nested) object flattened with dotted
  names. Documents are read once, as VARIANT: no inference pass, values of mixed
  types kept, broken documents counted on the way. A document per line is
  splittable; whole-file documents are one task a file.
* Paged envelopes ``{"data": [...], "metadata": {"page": n}}``: the
  reference fetches them over HTTP; here they are landed as files. One read gives
  the reviews, the list of pages and the failed ones.
* Landed JSON is compressed text: names and values repeat in every line. Such a file is one
  task when read, so files are kept small.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.functions.stats import observed

# ---- fixed values: pandas' default missing-value tokens (read_csv) --------
GAP_BLOCK = 4096  # page numbers unfolded at a time
LANDED = {"compression": "snappy", "maxRecordsPerFile": 20_000}  # how documents are landed as text
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
             "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


class SourceError(ValueError):
    """Unreadable or empty input."""


def _na_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[F.when(F.col(f"`{c}`").isin(NA_TOKENS), F.lit(None).cast("string"))
                       .otherwise(F.col(f"`{c}`")).alias(c) for c in df.columns])


def read_reviews_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                     multi_line: bool = False) -> DataFrame:
    """CSV with a header row -> reviews (text columns unless a schema is given). Files are
    split; set ``multi_line`` only where quoted fields hold line breaks (then a file is one task)."""
    r = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    if schema is not None:
        return r.schema(schema).csv(path)
    return _na_to_null(r.option("inferSchema", False).csv(path))


# ---- JSON documents as VARIANT -------------------------------------------------------------
@dataclass
class Landing:
    """Documents of one read: ``table`` holds a row for each review (``v``, VARIANT; ``flat``: the
    document itself is the review) and what was asked to be kept of its line; ``counts`` what
    was observed on the way."""

    table: DataFrame
    counts: dict[str, int]
    shapes: dict[bool, str | None]  # merged types of the rows' objects, by ``flat``

    def reviews(self, *keep: str) -> DataFrame:
        return _columns(self.table.where("v IS NOT NULL"), self.shapes, keep)


def _variant_rows(parsed: DataFrame, documents: bool) -> DataFrame:
    """A row for each review of the parsed documents ``v``: the top-level array's elements (only
    of ``documents``), else those of ``data``, else of ``records``, else the document itself.
    Elements that are no objects are none. A document without any review keeps one row, of null."""
    paths = (["$"] if documents else []) + ["$.data", *(["$.records"] if documents else [])]
    arrays = ", ".join(f"try_variant_get(v, '{p}', 'array<variant>')" for p in paths)
    whole = "CASE WHEN rows IS NULL AND is_object(v) THEN array(v) END" if documents else "NULL"
    is_object = "(try_variant_get({0}, '$', 'map<string,variant>') IS NOT NULL)"
    keep = [c for c in parsed.columns if c != "v"]
    got = parsed.selectExpr(*keep, "v", f"coalesce({arrays}, NULL) AS rows")
    got = got.selectExpr(*keep, "rows IS NULL AND v IS NOT NULL AS flat", "coalesce(rows, "
                         + whole.replace("is_object(v)", is_object.format("v")) + ") AS rows")
    return got.selectExpr(*keep, "flat", "posexplode_outer(rows) AS (pos, x)").selectExpr(
        *keep, "flat", "pos", f"CASE WHEN {is_object.format('x')} THEN x END AS v")


def land_documents(spark: SparkSession, path: str, multi_line: bool = False, pages: bool = False) -> Landing:
    """Read JSON documents once, a line each (or a file each), whatever their fields and types.

    Text is parsed to VARIANT, so nothing has to be known or inferred beforehand, and values of
    different types under one name are kept. While the rows are written to the shared folder the
    number of documents, of broken ones, of odd elements and the merged types are observed.
    ``pages`` keeps file name and envelope of every document, and only ``data`` holds reviews.
    """
    lines = spark.read.option("wholetext", multi_line).text(path)
    own = ["_metadata.file_name AS file"] if pages else []
    parsed = lines.selectExpr("value", *own).where("trim(value) <> ''").selectExpr(
        "try_parse_json(value) AS v", *(["file"] if pages else []))
    whole = Observation(f"documents-{uuid.uuid4().hex[:8]}")
    parsed = parsed.observe(whole, F.count(F.lit(1)).alias("documents"),
                            F.count_if(F.col("v").isNull()).alias("malformed"))
    if pages:
        parsed = parsed.selectExpr("v", "file", "v IS NULL AS broken",
                                   "try_variant_get(v, '$.metadata.page', 'int') AS number")
    rows = _variant_rows(parsed, not pages)
    shapes = {f"s{int(flat)}": F.expr(f"schema_of_variant_agg(CASE WHEN flat = {str(flat).lower()} THEN v END)")
              for flat in (False, True)}
    table, seen = observed(rows, {"rows": F.count("v"), **shapes}, "documents")
    counts = dict(whole.get) | {"rows": seen["rows"]}
    return Landing(table, counts, {flat: seen[f"s{int(flat)}"] for flat in (False, True)})


def _typed(dt: T.DataType) -> T.DataType:
    """Types as reviews use them: decimals are doubles; values of several types stay text."""
    if isinstance(dt, T.StructType):
        return T.StructType([T.StructField(f.name, _typed(f.dataType)) for f in dt.fields])
    if isinstance(dt, T.ArrayType):
        return T.ArrayType(_typed(dt.elementType))
    if isinstance(dt, (T.DecimalType, T.FloatType)):
        return T.DoubleType()
    return T.StringType() if isinstance(dt, (T.VariantType, T.NullType)) else dt


def _fields(shape: str | None, nested: bool) -> dict[str, tuple[str, T.DataType]]:
    """Column name to (path in the object, type) of a merged object type ('OBJECT<...>');
    ``nested``: objects inside are flattened to names a.b.c."""
    if not shape or not shape.startswith("OBJECT<"):
        return {}
    struct = T.StructType.fromDDL(shape.replace("OBJECT<", "STRUCT<"))
    struct = struct.fields[0].dataType if len(struct.fields) == 1 and isinstance(
        struct.fields[0].dataType, T.StructType) and struct.fields[0].name == "value" else struct
    out = {}

    def walk(dt: T.StructType, names: list[str]) -> None:
        for f in dt.fields:
            if nested and isinstance(f.dataType, T.StructType):
                walk(f.dataType, [*names, f.name])
            else:
                path = "$" + "".join("['" + n.replace("\\", "\\\\").replace("'", "\\'") + "']"
                                     for n in [*names, f.name])
                out[".".join([*names, f.name])] = (path, _typed(f.dataType))

    walk(struct, [])
    return out


def _columns(table: DataFrame, shapes: dict[bool, str | None], keep: tuple[str, ...]) -> DataFrame:
    rows, flat = _fields(shapes[False], False), _fields(shapes[True], True)
    out = [F.col(c) for c in keep]
    for name in [*rows, *(n for n in flat if n not in rows)]:
        if name in ("metadata",) and name not in rows:
            continue
        kinds = {d[name][1].simpleString(): d[name][1] for d in (rows, flat) if name in d}
        kind = next(iter(kinds)) if len(kinds) == 1 else "string"

        def got(d, name=name, kind=kind):
            return F.try_variant_get("v", d[name][0], kind) if name in d else F.lit(None).cast(kind)

        if name in rows and name in flat:
            out.append(F.when(F.col("flat"), got(flat)).otherwise(got(rows)).alias(name))
        else:  # a path of the one kind of row may exist in the other by chance
            out.append(F.when(F.col("flat") == F.lit(name in flat), got(flat if name in flat else rows)).alias(name))
    return table.select(*out)


def read_reviews_json(spark: SparkSession, path: str, schema=None, multi_line: bool = False
                      ) -> DataFrame:
    """JSON documents in any of the four shapes -> reviews, each row by its own shape.

    One document per line (splittable); ``multi_line`` reads a file as one document.
    A top-level array or a document with ``data`` gives that array's rows, else one with
    ``records`` that array's, else itself, flattened. There is no inference pass: the types are
    merged while the documents are read (once). With a ``schema`` of the reviews' fields, fields
    are read by it and nothing is merged. Lines that are no JSON are counted in the same read
    (``land_documents``). A source without any document that can be read is a ``SourceError``.
    """
    landing = land_documents(spark, path, multi_line)
    if landing.counts["documents"] and landing.counts["malformed"] == landing.counts["documents"]:
        raise SourceError(f"Invalid JSON file: {path}")
    if schema is None:
        return landing.reviews()
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return landing.table.where("v IS NOT NULL").select(*[
        F.try_variant_get("v", "$['" + f.name.replace("'", "\\'") + "']", f.dataType.simpleString()).alias(f.name)
        for f in struct.fields])


def malformed_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row: documents, and documents that are no JSON, of one read."""
    counts = land_documents(spark, path).counts
    return spark.createDataFrame([(counts["documents"], counts["malformed"])],
                                 "documents long, malformed long")


def read_reviews_jsonl(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """One review per line (splittable; the format to land at scale)."""
    r = spark.read
    return (r.schema(schema) if schema is not None else r).json(path)


# ---- landed pages ----------------------------------------------------------------------------
@dataclass
class PageLanding:
    """One read of landed pages: ``reviews``, ``pages`` (page, rows, broken: a row a page) and the
    counts that were observed while reading."""

    reviews: DataFrame
    pages: DataFrame
    counts: dict[str, int]

    def failed(self, requested: int | None = None) -> DataFrame:
        """Requested pages 1..N that gave no review: missing, empty or broken ones."""
        return page_gap_report(self.pages.sparkSession, self.pages, requested)


def land_pages(spark: SparkSession, path: str, max_pages: int | None = None,
               multi_line: bool = False) -> PageLanding:
    """Paged envelopes (one a line, or one a file) -> reviews, page list and failed pages.

    The page number is ``metadata.page``, else the number in the file name. ``max_pages`` leaves
    out pages with a larger number; pages without a number stay. A broken envelope is a page
    without reviews; its number is the file's."""
    landing = land_documents(spark, path, multi_line, pages=True)
    number = ("coalesce(number, try_cast(nullif(regexp_extract(file, "
              "'page[=_-]?(\\\\d+)', 1), '') as int)) AS page")
    table = landing.table.selectExpr(number, "pos AS page_pos", "flat", "broken", "v")
    if max_pages is not None:
        table = table.where(F.col("page").isNull() | (F.col("page") <= int(max_pages)))
    pages = table.groupBy("page").agg(F.count("v").cast("int").alias("rows"),
                                      F.count_if("broken").alias("broken"))
    reviews = _columns(table.where("v IS NOT NULL"), landing.shapes, ("page", "page_pos"))
    return PageLanding(reviews, pages, landing.counts)


def read_review_pages(spark: SparkSession, path: str, max_pages: int | None = None,
                      multi_line: bool = False) -> DataFrame:
    """Paged envelopes -> reviews with ``page`` and ``page_pos`` columns. Empty or missing pages
    are tolerated; no rows at all is an error of ``load_reviews``."""
    return land_pages(spark, path, max_pages, multi_line).reviews


def page_envelopes(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Page number and review count of every landed page (empty and broken ones included)."""
    return land_pages(spark, path, multi_line=multi_line).pages


def page_gap_report(spark: SparkSession, pages: DataFrame, requested: int | None = None
                    ) -> DataFrame:
    """Requested pages 1..N without data: pages 1..N LEFT ANTI JOIN non-empty pages.
    ``requested`` defaults to the largest landed page number; pass it to see gaps after
    the last landed page. Lazy: the largest number is a one-row frame, unfolded by many tasks.

    Both sides grow with the number of pages and are merged by page: the landed side looks small
    to the planner (a number beside a VARIANT), which would broadcast it through the driver."""
    have = pages.filter(F.col("rows") > 0).select("page").distinct()
    if requested is not None:
        want = spark.range(1, int(requested) + 1).select(F.col("id").cast("int").alias("page"))
    else:
        last = pages.agg(F.max("page").alias("top"))
        blocks = last.select(F.explode(F.sequence(F.lit(0), F.coalesce(
            F.floor(F.col("top") / F.lit(GAP_BLOCK)), F.lit(0)))).alias("b"), "top").repartition(
            int(spark.conf.get("spark.sql.shuffle.partitions")), "b")
        want = blocks.select("top", F.explode(F.sequence(
            F.col("b") * GAP_BLOCK, (F.col("b") + 1) * GAP_BLOCK - 1)).alias("p")).where(
            "p between 1 and top").select(F.col("p").cast("int").alias("page"))
    return want.join(have.hint("merge"), "page", "left_anti")


def load_reviews(spark: SparkSession, mode: str, path: str, max_pages: int | None = None,
                 **opts) -> DataFrame:
    """One entry for every source kind ('csv', 'json', 'jsonl', 'pages'): read,
    reject empty input, normalise with the dashboard profile."""
    from revlens.operators.reviews import fetch_column_repair, normalize_reviews

    if mode == "csv":
        df = read_reviews_csv(spark, path, opts.get("schema"), opts.get("multi_line", False))
    elif mode == "json":
        df = read_reviews_json(spark, path, opts.get("schema"), opts.get("multi_line", False))
    elif mode == "jsonl":
        df = read_reviews_jsonl(spark, path, opts.get("schema"))
    elif mode == "pages":
        df = fetch_column_repair(read_review_pages(spark, path, max_pages,
                                                   opts.get("multi_line", False)))
    else:
        raise ValueError(f"Invalid input mode: {mode}")
    if df.isEmpty():
        raise SourceError("No valid data loaded from source")
    return normalize_reviews(df)


# ---- sinks ------------------------------------------------------------------------------


def write_reviews_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_review_pages(df: DataFrame, path: str, page_col: str = "page") -> None:
    """One envelope per page, one envelope per line, compressed. ``df`` must carry a page
    number; each envelope holds only that page's rows (bounded by page size)."""
    cols = [c for c in df.columns if c != page_col]
    env = df.groupBy(page_col).agg(F.collect_list(F.struct(*cols)).alias("data"))
    env.select(F.col("data"), F.struct(F.col(page_col).alias("page")).alias("metadata")) \
        .write.mode("overwrite").options(**LANDED).json(path)


def write_dashboard_json(records: DataFrame, path: str) -> None:
    """Product records as JSON Lines (one product record per line)."""
    records.write.mode("overwrite").json(path)
