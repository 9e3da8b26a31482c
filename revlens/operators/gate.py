"""A gate on the way: row constraints checked in the pass that writes the data.

Every constraint is a condition on one row. While the input is written once to the shared folder
each row gets the names of the critical constraints it breaks, and the violations of every
constraint are observed; so the good rows, the quarantined ones and the report come from one
read of the input. Nothing is dropped: good and quarantined rows together are the input.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.functions import columns as C
from revlens.functions import constants as K
from revlens.functions.stats import observed
from revlens.operators.reviews import NUMERIC_TYPES

REPORT = "constraint string, column string, severity string, violations bigint, rows bigint"


class DataError(ValueError):
    """Raised when input data cannot be used at all (empty, columns missing)."""


@dataclass(frozen=True)
class Constraint:
    """``holds`` is true where a row is good; a null condition counts as broken."""

    name: str
    column: str
    holds: Column
    severity: str = "critical"

    @property
    def broken(self) -> Column:
        return ~F.coalesce(self.holds, F.lit(False))


def not_null(column: str, severity: str = "critical") -> Constraint:
    c = F.col(f"`{column}`")
    return Constraint(f"{column}_present", column, c.isNotNull(), severity)


def numeric(column: str, severity: str = "critical") -> Constraint:
    """A number, or text that holds one; NaN is none."""
    return Constraint(f"{column}_numeric", column, C.to_double(F.col(f"`{column}`")).isNotNull(), severity)


def between(column: str, low: float | None, high: float | None, severity: str = "critical") -> Constraint:
    """Inside the bounds; values that are no numbers are left to ``numeric``."""
    x = C.to_double(F.col(f"`{column}`"))
    inside = F.lit(True)
    if low is not None:
        inside = inside & (x >= low)
    if high is not None:
        inside = inside & (x <= high)
    return Constraint(f"{column}_range", column, x.isNull() | inside, severity)


def not_blank(column: str, severity: str = "critical") -> Constraint:
    return Constraint(f"{column}_not_blank", column, C.strip_ws(F.col(f"`{column}`").cast("string")) != "", severity)


def output_constraints(df: DataFrame) -> list[Constraint]:
    """What the robust pipeline promises of its output: every schema column present and usable,
    numbers inside their ranges."""
    out = []
    for c, kind in K.ROBUST_SCHEMA.items():
        if c in df.columns:
            out.append(not_null(c) if kind == "str" else numeric(c))
            if c in K.ROBUST_RANGES:
                out.append(between(c, *K.ROBUST_RANGES[c], severity="warning"))
    return out


def input_constraints(df: DataFrame) -> list[Constraint]:
    """What a raw review must hold to be taken as it is: a product, numbers that are numbers."""
    numbers = [("rating", 1.0, 5.0), ("customer_ltv", 0.0, None), ("order_value", 0.0, None),
               ("days_since_purchase", 0.0, None), ("helpful_votes", 0.0, None)]
    out = [not_blank("product")] if "product" in df.columns else []
    for c, low, high in numbers:
        if c in df.columns:
            out += [numeric(c), between(c, low, high)]
    if "review_text" in df.columns:
        out.append(not_null("review_text", "warning"))
    return out


@dataclass
class Checked:
    good: DataFrame
    quarantine: DataFrame   # the input's columns and ``violated``, names of critical constraints
    rows: int
    violations: dict[str, int]
    constraints: list[Constraint]

    @property
    def columns(self) -> list[str]:
        return self.good.columns

    def report(self) -> DataFrame:
        """A row for every constraint: its violations, of how many rows."""
        rows = [(c.name, c.column, c.severity, self.violations[c.name], self.rows) for c in self.constraints]
        return self.good.sparkSession.createDataFrame(rows, REPORT)

    def raise_if_unusable(self, required: list[str] = ()) -> Checked:
        """``DataError`` without rows, without a required column, or with a critical violation."""
        found = [] if self.rows else ["Dataset is empty"]
        found += [f"Missing column: {c}" for c in required if c not in self.good.columns]
        found += [f"Column '{c.column}' breaks {c.name} in {self.violations[c.name]} rows"
                  for c in self.constraints if c.severity == "critical" and self.violations[c.name]]
        if found:
            raise DataError("Critical validation failed: " + "; ".join(found))
        return self


def check_rows(df: DataFrame, constraints: list[Constraint]) -> Checked:
    """Write ``df`` once, checked; see the module's text."""
    critical = [F.when(c.broken, F.lit(c.name)) for c in constraints if c.severity == "critical"]
    mark = "violated"
    while mark in df.columns:
        mark += "_"
    names = F.array_compact(F.array(F.lit(None).cast("string"), *critical))
    counts = {f"v{i}": F.count_if(c.broken) for i, c in enumerate(constraints)}
    table, seen = observed(df.select("*", names.alias(mark)), {"rows": F.count(F.lit(1)), **counts}, "checked")
    kept = [F.col(f"`{c}`") for c in df.columns]
    return Checked(table.where(F.size(mark) == 0).select(*kept), table.where(F.size(mark) > 0),
                   seen["rows"] or 0, {c.name: seen[f"v{i}"] or 0 for i, c in enumerate(constraints)}, constraints)


def types_match(df: DataFrame) -> list[str]:
    """Schema columns whose type is another than the robust schema's."""
    kinds = {"float": NUMERIC_TYPES, "str": T.StringType,
             "int": (T.ByteType, T.ShortType, T.IntegerType, T.LongType)}
    return [c for c, kind in K.ROBUST_SCHEMA.items()
            if c in df.columns and not isinstance(df.schema[c].dataType, kinds[kind])]
