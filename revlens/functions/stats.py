"""Global statistics: observed while a table is written, or as one-row DataFrames.

Statistics that the rows of a large input are scaled by are observed in the same pass that
writes this input (``observed``). Others are one-row frames attached by a broadcast cross join;
one row has a proven size bound.

Exact quantiles (pandas ``quantile``, linear interpolation; equal to SQL
``quantile_cont``) take the same path at every size, without an array of values:

1. one aggregate gives the count, the least and largest value and, from ``percentile_approx`` (a
   mergeable sketch; relative rank error ``1/accuracy``), values below and above ``q``; the
   bracket is the closest pair that holds the two target ranks whatever the error: ``3/accuracy``
   on either side of ``q`` from ``accuracy`` values on, ``2/FEW`` from ``FEW`` on, else all values;
2. the values inside the bracket are counted by ``groupBy`` (ties are one row, and
   partial sums absorb them), and the values below it by the same pass;
3. running counts give the values at ranks ``floor(r)`` and ``ceil(r)``,
   ``r = q (n - 1)``, and the interpolation.

Step 3 orders the distinct values of one bracket: a share of about ``8/accuracy`` of many values.
Everything stays lazy; the result is a one-row frame.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions.columns import col_

DEFAULT_ACCURACY = 100_000
FEW = 1_000


def with_stats(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Attach a one-row statistics frame to every row (broadcast, no shuffle)."""
    return df.crossJoin(F.broadcast(stats))


def observed(df: DataFrame, aggs: dict[str, Column], name: str = "observed") -> tuple[DataFrame, dict]:
    """``df`` written once to the shared folder, and aggregates of it that were observed while
    it was written: one pass over the input gives both. The values are plain numbers, so what
    uses them needs neither a join nor a subquery."""
    from pyspark.sql import Observation

    from revlens.session import written

    seen = Observation(f"{name}-{uuid.uuid4().hex[:8]}")
    table = written(df.observe(seen, *[c.alias(n) for n, c in aggs.items()]), name)
    return table, dict(seen.get)


def observed_minmax(df: DataFrame, cols: dict[str, Column | str]
                    ) -> tuple[DataFrame, dict[str, tuple[Column, Column]]]:
    """``df`` written once, and (minimum, maximum) of each column as literals."""
    aggs = {f"{fn}_{n}": f(col_(c)) for n, c in cols.items() for fn, f in (("min", F.min), ("max", F.max))}
    table, got = observed(df, aggs)
    return table, {n: tuple(F.lit(got.get(f"{fn}_{n}")).cast("double") for fn in ("min", "max")) for n in cols}


def minmax_stats(df: DataFrame, cols: dict[str, Column | str], prefix: str = "__") -> DataFrame:
    """One aggregate: ``{prefix}min_{name}``, ``{prefix}max_{name}`` for each column."""
    aggs = []
    for name, c in cols.items():
        aggs += [F.min(col_(c)).alias(f"{prefix}min_{name}"),
                 F.max(col_(c)).alias(f"{prefix}max_{name}")]
    return df.agg(*aggs)


def quantiles(df: DataFrame, specs: list[tuple[str, Column | str, float]],
              method: str = "bracket", accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    """One-row frame with one column per ``(name, column, q)`` spec.

    ``method='bracket'`` is the exact selection described above; ``method='exact'``
    uses Spark's ``percentile`` (all distinct values in one buffer: only for tables
    known to be small); ``method='approx'`` returns ``percentile_approx``.
    """
    k = len(specs)
    base = df.select(*[col_(c).cast("double").alias(f"__q{i}")
                       for i, (_n, c, _q) in enumerate(specs)])
    if method == "exact":
        return base.agg(*[F.expr(f"percentile(__q{i}, {float(q)!r})").alias(name)
                          for i, (name, _c, q) in enumerate(specs)])
    if method == "approx":
        return base.agg(*[F.expr(f"percentile_approx(__q{i}, {float(q)!r}, {accuracy})")
                          .alias(name) for i, (name, _c, q) in enumerate(specs)])
    if method != "bracket":
        raise ValueError(f"unknown quantile method {method!r}")

    tight, wide = 3.0 / accuracy, 2.0 / FEW
    probes = base.agg(*[F.expr(e) for i, (_n, _c, q) in enumerate(specs) for e in (
        f"count(__q{i}) as n{i}", f"min(__q{i}) as min{i}", f"max(__q{i}) as max{i}",
        f"percentile_approx(__q{i}, array({', '.join(repr(min(1.0, max(0.0, q + m))) for m in (-tight, tight, -wide, wide))}), "
        f"{accuracy}) as p{i}")])
    bracket = probes.select(*[F.expr(e) for i in range(k) for e in (
        f"n{i}", f"case when n{i} >= {accuracy} then p{i}[0] when n{i} >= {FEW} then p{i}[2] else min{i} end as a{i}",
        f"case when n{i} >= {accuracy} then p{i}[1] when n{i} >= {FEW} then p{i}[3] else max{i} end as b{i}")])
    # a row for each spec whose bracket (or what lies below it: x is null) holds the value
    marked = with_stats(base, bracket).selectExpr("inline(filter(array(" + ", ".join(
        f"struct({i} as i, case when __q{i} >= a{i} then __q{i} end as x, "
        f"__q{i} <= b{i} as held, n{i} as n)" for i in range(k)) + "), s -> s.held))")
    counted = marked.groupBy("i", "x").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n"))
    upto = Window.partitionBy("i").orderBy(F.col("x").asc_nulls_first())
    ranked = counted.withColumn("upto", F.sum("c").over(upto)).where("x is not null")
    out = []
    for i, (name, _c, q) in enumerate(specs):
        r = f"(cast(n - 1 as double) * {float(q)!r})"
        out += [F.expr(f"min(case when i = {i} and upto > floor({r}) then x end)").alias(f"lo{i}"),
                F.expr(f"min(case when i = {i} and upto > ceil({r}) then x end)").alias(f"hi{i}"),
                F.expr(f"max(case when i = {i} then {r} - floor({r}) end)").alias(f"fr{i}")]
    return ranked.agg(*out).selectExpr(*[f"lo{i} + (hi{i} - lo{i}) * fr{i} as `{name}`"
                                         for i, (name, _c, _q) in enumerate(specs)])
