"""Mixing sources to target weights by entropy balancing.

Sources (by code point, null last) weigh 3, 1, 2, 3, 1, 2, ... and share ``BUDGET`` times all
words; a target above ``MOST`` times its source's words stops there and the excess is shared by
weight among the others, until none is above.

Each document gets a rate between 0 and ``MOST``, the closest to 1 in (bounded) entropy under
which the expected words of its source equal the target. The dual is convex, with one
multiplier for each source, and its solution tilts the rates exponentially:

    rate_d = MOST * e^z / (1 + e^z) with z = lambda_source * size_d / mean size of the source

Newton's method runs on all sources at once, over the counts of (source, size), which is all that
the dual needs of the corpus. A pass is one aggregate that evaluates several trial multipliers of
every source: the Newton point of the best trial so far and points between it and the ends of the
interval in which the root is known to lie. So the interval shrinks by orders of magnitude a
pass, and a few passes do. They end when every source's constraint holds within ``TOLERANCE``.

Rates are rounded to whole copies within groups of about ``GROUP`` documents of one source
(a hash of the id deals them, so a source of any size is many groups): from the largest
document to the smallest, each takes the whole number of copies next to its rate that keeps
the group's sum of words closest to the rates'. Rows equal in source, id and size are counted
first and dealt as entries of up to ``GROUP`` rows, one after the other to the following groups;
an entry's rows share its copies evenly. Documents without words are rounded each by itself. So
the error of a source is a few words of its shortest documents, no document exceeds ``MOST``
copies, and reruns agree.

``mixed_documents`` gives every row its own copies, also rows whose id is null or repeats: rows of
one (source, id, size) are numbered by their place in the written table, inside each of its
partitions and by the partitions' prefix sums, and the number names the entry.

Cases: null text has size 0; sources without words have target 0; null ids and repeated rows
are rows like others; an empty table gives no rows; of the input only id, source and text are
read (``mixed_documents`` returns all columns).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm.common import WORD_PATTERN, checkpointed
from revlens.session import written

WEIGHTS = (3.0, 1.0, 2.0)
BUDGET = 1.5
MOST = 2.0
PASSES = 12
TOLERANCE = 1e-6
FIRST = (0.0, -0.25, 0.25, -0.5, 0.5, -1.0, 1.0, -2.0, 2.0, -4.0, 4.0, -16.0, 16.0)  # trials about the start
CLOSE = (1e-6, 1e-4, 1e-2, 0.1, 0.5)  # later ones, as shares of the way from Newton's point to each end
GROUP = 400


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, rounds: int | None = None) -> DataFrame:
    """(s, source_size, target): ``sizes`` has one row for each source: s, source_size.

    Water filling: sources are ranked by size over weight; the smallest stop first. A source
    stops iff the share that is left when all before it have stopped exceeds its stop.
    """
    order = Window.orderBy(F.col("s").asc_nulls_last())  # one row for each source
    ranked = sizes.withColumn("k", F.row_number().over(order) - 1).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("k") % len(WEIGHTS) + 1).cast("int")))
    by = Window.orderBy(F.col("source_size") / F.col("weight"), "k")
    upto = by.rowsBetween(Window.unboundedPreceding, -1)
    every = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = (ranked.withColumn("stopped", F.coalesce(F.sum("source_size").over(upto), F.lit(0)) * F.lit(MOST))
              .withColumn("open_weight", F.sum("weight").over(every)
                          - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
              .withColumn("budget", F.sum("source_size").over(every) * F.lit(BUDGET))
              .withColumn("unit", (F.col("budget") - F.col("stopped")) / F.col("open_weight"))
              .withColumn("stops", F.col("unit") * F.col("weight") > F.col("source_size") * F.lit(MOST)))
    # sources stop from the front on; the first that doesn't sets the unit for all after it
    unit = F.min_by(F.when(~F.col("stops"), F.col("unit")), F.when(~F.col("stops"), F.struct(
        F.col("source_size") / F.col("weight"), "k"))).over(every.orderBy())
    return filled.withColumn("u", unit).select("s", "source_size", F.when(
        F.col("stops") | F.col("u").isNull(), F.col("source_size") * F.lit(MOST))
        .otherwise(F.col("u") * F.col("weight")).alias("target"))


def _rate(lam: Column, x: Column) -> Column:
    return F.lit(MOST) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), lam * x))))


def tilted(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """(s, source_size, target, docs, mean, lam): the dual's solution; lam is null where all rates stop.

    counts: (s, size, c), c documents of this size; targets as from ``source_targets``.
    """
    work = counts.where("size > 0")
    about = work.groupBy("s").agg(
        F.sum("c").alias("docs"), (F.sum(F.col("size") * F.col("c")) / F.sum("c")).alias("mean"))
    ratio = F.try_divide(F.col("target"), F.col("source_size") * F.lit(MOST))  # null without words
    start = F.when((ratio > 0) & (ratio < 1 - 1e-9), F.ln(ratio / (1 - ratio)))
    state = checkpointed(
        _with(targets, about, "left").withColumn("lam", start)
        .withColumn("lo", F.lit(-1e6)).withColumn("hi", F.lit(1e6))
        .withColumn("trials", F.array(*[F.col("lam") + t for t in FIRST])))
    few = state.count() <= SENT_SOURCES
    for _ in range(PASSES):
        state, off = _narrowed(work, state, few)
        if off <= TOLERANCE:
            break
    return state.select("s", "source_size", "target", "docs", "mean", "lam")


def _narrowed(work: DataFrame, state: DataFrame, few: bool) -> tuple[DataFrame, float]:
    """One pass: the state with the best multipliers, smaller intervals and new trials; and the
    largest relative error of a source."""
    n = len(FIRST)
    x, words = F.col("size") / F.col("mean"), F.col("c") * F.col("size")
    at = _with_source(work, state.where("lam IS NOT NULL").select("s", "mean", "trials"), few)
    sums = []
    for k in range(n):
        rate = _rate(F.col("trials")[k], x)
        sums += [F.sum(words * rate).alias(f"w{k}"), F.sum(words * x * rate * (1 - rate / MOST)).alias(f"d{k}")]
    now = _with(state, at.groupBy("s").agg(*sums), "left")
    tried = now.withColumn("t", F.array(*[F.struct(
        F.abs(F.col(f"w{k}") - F.col("target")).alias("miss"), F.col("trials")[k].alias("lam"),
        (F.col(f"w{k}") - F.col("target")).alias("off"), F.col(f"d{k}").alias("slope")) for k in range(n)]))
    best = F.array_min("t")
    below = F.array_max(F.transform(F.filter("t", lambda t: t["off"] <= 0), lambda t: t["lam"]))
    above = F.array_min(F.transform(F.filter("t", lambda t: t["off"] >= 0), lambda t: t["lam"]))
    tried = (tried.withColumn("best", best).withColumn("lo", F.greatest("lo", below))
             .withColumn("hi", F.least("hi", above)))
    newton = F.col("best.lam") - F.try_divide(F.col("best.off"), F.col("best.slope"))
    inside = (newton > F.col("lo")) & (newton < F.col("hi"))
    tried = tried.withColumn("p", F.when(inside, newton).otherwise((F.col("lo") + F.col("hi")) / 2))
    trials = [F.col("p")] + [F.col("p") + (F.col(end) - F.col("p")) * t for t in CLOSE for end in ("lo", "hi")]
    trials += [F.col("best.lam")] * (n - len(trials))
    after = checkpointed(tried.select(
        "s", "source_size", "target", "docs", "mean", F.col("best.lam").alias("lam"), "lo", "hi",
        F.array(*trials).alias("trials"), (F.col("best.miss") / F.col("target")).alias("miss")))
    return after.drop("miss"), after.agg(F.max("miss")).first()[0] or 0.0


SENT_SOURCES = 20_000  # one small row each; more are joined by a shuffle


def _with_source(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    return _with(rows, F.broadcast(sources) if few else sources, "inner")


def _with(rows: DataFrame, sources: DataFrame, how: str) -> DataFrame:
    """Joined by s; the key of the right side is renamed, as both may stem from one frame."""
    return rows.join(sources.withColumnRenamed("s", "s__"), F.col("s").eqNullSafe(F.col("s__")), how).drop("s__")


def _sources(sized: DataFrame) -> DataFrame:
    """(s, source_size, target, docs, mean, lam) of every source."""
    counts = checkpointed(sized.groupBy("s", "size").agg(F.count(F.lit(1)).alias("c")))
    sizes = counts.groupBy("s").agg(F.sum(F.col("size") * F.col("c")).alias("source_size"))
    return tilted(counts, source_targets(sizes))


def _rates() -> Column:
    return (F.when(F.col("target") <= 0, F.lit(0.0)).when(F.col("lam").isNull(), F.lit(MOST))
            .otherwise(_rate(F.col("lam"), F.col("size") / F.col("mean"))))


def _wordless(sized: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    return (_with_source(sized.where("size = 0"), sources, few).withColumn("rate", _rates())
            .withColumn("copies", F.round("rate").cast("long")))


def entries(sized: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """(s, doc_id, size, part, c, k, rate, source_size, target): k copies for the c rows of an
    entry, which is the ``part``-th run of ``GROUP`` rows of one (s, doc_id, size)."""
    equal = sized.where("size > 0").groupBy("s", "doc_id", "size").agg(F.count(F.lit(1)).alias("c"))
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("c") - 1) / GROUP)))
    groups = F.ceil(F.col("docs") / F.lit(GROUP))
    dealt = (_with_source(equal, sources, few).withColumn("rate", _rates()).withColumn("part", part)
             .withColumn("c", F.least(F.lit(GROUP).cast("long"), F.col("c") - F.col("part") * GROUP))
             .withColumn("g", F.pmod(F.pmod(F.xxhash64("doc_id", "size"), groups) + F.col("part"), groups)))
    listed = dealt.groupBy("s", "g", "source_size", "target").agg(
        F.sort_array(F.collect_list(F.struct("size", "doc_id", "rate", "c", "part")), asc=False).alias("d"))

    def step(acc: Column, x: Column) -> Column:
        off = acc["err"] - x["rate"] * x["size"] * x["c"]  # without these documents
        k = F.greatest(F.lit(0.0), F.least(F.lit(MOST) * x["c"], F.round(-off / x["size"]))).cast("long")
        return F.struct((off + k * x["size"]).alias("err"), F.concat(acc["out"], F.array(k)).alias("out"))

    rounded = listed.withColumn("k", F.aggregate(
        "d", F.struct(F.lit(0.0).alias("err"), F.array().cast("array<bigint>").alias("out")),
        step, lambda acc: acc["out"]))
    return rounded.select("s", "source_size", "target", F.explode(F.arrays_zip("d", "k")).alias("x")).select(
        "s", "x.d.doc_id", "x.d.size", "x.d.part", "x.d.c", "x.k", "x.d.rate", "source_size", "target")


def _share(row: Column) -> Column:
    """Copies of the row of an entry with this number (from 0): the first take what is over."""
    return F.floor(F.col("k") / F.col("c")) + F.when(row < F.pmod("k", "c"), 1).otherwise(0)


def mix(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken, copies, rate."""
    sized = checkpointed(docs.select("doc_id", F.col("source").cast("string").alias("s"),
                                     word_count(F.col("text").cast("string")).alias("size")))
    sources = _sources(sized)
    few = sources.count() <= SENT_SOURCES
    wordless = _wordless(sized, sources, few).select(
        "doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), "copies", "rate")
    each = entries(sized, sources, few).withColumn(
        "row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1))).withColumn("copies", _share(F.col("row")))
    return each.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
                       "copies", "rate").unionByName(wordless)


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (row, s, doc_id, size) with ``n``, the number (from 0) of each among those equal
    in s, doc_id and size. ``row`` holds the partition in its upper bits: numbers run inside a
    partition's share of a group, and the shares before are added, one row a partition."""
    key = ["s", "doc_id", "size"]
    rows = rows.withColumn("p", F.shiftright("row", 33))
    inside = Window.partitionBy(*key, "p").orderBy("row")
    shares = rows.groupBy(*key, "p").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy(*key).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    base = (shares.withColumn("base", F.sum("c").over(before)).where("base > 0")
            .select(*[F.col(k).alias(f"{k}_b") for k in [*key, "p"]], "base"))
    same = (F.col("s").eqNullSafe(F.col("s_b")) & F.col("doc_id").eqNullSafe(F.col("doc_id_b"))
            & (F.col("size") == F.col("size_b")) & (F.col("p") == F.col("p_b")))
    return (rows.withColumn("n", F.row_number().over(inside) - 1).join(base, same, "left")
            .select("row", *key, (F.col("n") + F.coalesce("base", F.lit(0))).alias("n")))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it."""
    names, own = docs.columns, "row__"
    while own in names or own + "size" in names:
        own += "_"
    # written with row numbers and sizes, so that only the join at the end reads texts again
    stored = written(docs.withColumn(own, F.monotonically_increasing_id())
                     .withColumn(own + "size", word_count(F.col("text").cast("string"))), "mixing")
    sized = stored.select(F.col(own).alias("row"), "doc_id", F.col("source").cast("string").alias("s"),
                          F.col(own + "size").alias("size"))
    sources = _sources(sized)
    few = sources.count() <= SENT_SOURCES
    wordless = _wordless(sized, sources, few).select("row", "copies")
    rows = _numbered(sized.where("size > 0")).withColumn("part", F.floor(F.col("n") / GROUP))
    dealt = entries(sized, sources, few).select(
        *[F.col(k).alias(f"{k}_e") for k in ("s", "doc_id", "size", "part")], "c", "k")
    same = (F.col("s").eqNullSafe(F.col("s_e")) & F.col("doc_id").eqNullSafe(F.col("doc_id_e"))
            & (F.col("size") == F.col("size_e")) & (F.col("part") == F.col("part_e")))
    copies = (rows.join(dealt, same).withColumn("copies", _share(F.pmod("n", F.lit(GROUP)))).select("row", "copies")
              .unionByName(wordless).where("copies > 0")
              .select(F.col("row").alias("r__"), F.expr("sequence(1L, copies)").alias("k__")))
    taken = stored.join(copies, stored[own] == copies["r__"])
    return taken.select(*[stored[n] for n in names], F.explode(copies["k__"]).alias(own)).drop(own)
