"""Licence scan: a trained paragraph classifier.

Paragraphs (lines) are turned into hashed word 1- to 3-grams; a multinomial logistic regression
tells licence families and an unknown class. It is trained here: on the templates (whole and
cut at either end), against corpus paragraphs of a bounded sample and against the templates'
own words out of order, both labelled unknown. One part in four of the rows is kept back; the
least probability that a family needs is set so that of the unknown rows kept back no more
than ``FALSE_ALARMS`` reach it (and ``LEAST`` at least). A prediction counts only if a template of the
family confirms it: ``CONFIRM`` of the template's word pairs must be in the paragraph.

A notice may be wrapped: besides each line, the runs of neighbouring lines that the longest
template can lie across are paragraphs too (no blank line in between; of the first and the last
line only the words that the template reaches). A run is named by its first line. It counts
only if no shorter run or line within it is found for the same family, and of runs that overlap
the first counts.

Only expressions and Spark ML's JVM estimators are used. Documents without any of the
templates' longer words can't be confirmed and are passed over by one pattern match; all
others are scanned whole, paragraph by paragraph.

Cases: null and empty texts have no paragraphs; repeated documents give repeated rows; null ids
are given back; a paragraph that fits two families gets the likelier one; an empty table trains
on templates alone and gives no rows; only id and text are read.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FEATURES = 1 << 14
SAMPLE_DOCUMENTS = 500     # documents that unknown paragraphs are taken from, at most
FALSE_ALARMS = 0.001
LEAST = 0.5
CONFIRM = 0.6

# fixed values: families and the notices that name them
UNKNOWN = "unknown"
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of "
               "the License at apache.org"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are "
            "permitted provided that the following conditions are met"),
    ("bsd", "Licensed under the BSD License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as "
            "published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
            "and associated documentation files"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
]
LONGEST = max(len(re.findall(r"[^\W\d_]+", t)) for _, t in TEMPLATES)  # words
FAMILIES = [UNKNOWN, *sorted({f for f, _ in TEMPLATES})]


def words(paragraph: Column) -> Column:
    return F.regexp_extract_all(F.lower(paragraph), F.lit(r"(\p{L}+)"))


def pairs(w: str) -> Column:
    """Neighbouring words of the array column ``w``. By slices, not by index: an expression
    behind ``w`` is then evaluated a few times a row, not once for each word."""
    return F.expr(f"zip_with(slice({w}, 1, greatest(size({w}) - 1, 0)), slice({w}, 2, greatest(size({w}) - 1, 0)), "
                  f"(a, b) -> concat_ws(' ', a, b))")


def grams(w: str) -> Column:
    """Word 1- to 3-grams of the array column ``w``."""
    three = F.expr(
        f"zip_with(zip_with(slice({w}, 1, greatest(size({w}) - 2, 0)), slice({w}, 2, greatest(size({w}) - 2, 0)), "
        f"(a, b) -> concat_ws(' ', a, b)), slice({w}, 3, greatest(size({w}) - 2, 0)), (a, b) -> concat_ws(' ', a, b))")
    return F.concat(F.col(w), pairs(w), three)


def pairs_of(text: str) -> list[str]:
    w = re.findall(r"[^\W\d_]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def anchors() -> str:
    """Pattern of the templates' words of five letters or more."""
    found = {w for _, t in TEMPLATES for w in re.findall(r"[^\W\d_]+", t.lower()) if len(w) > 4}
    return r"(?i)\b(" + "|".join(sorted(found | {"cc", "gnu", "bsd", "mit"})) + r")\b"


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, row, paragraph, upto, w): words of the lines with an anchor word, numbered from 0,
    and of the runs of lines that begin with one."""
    text = F.col("text").cast("string")

    def follow(acc: Column, x: Column) -> Column:
        w = words(x)
        longer = F.struct((acc["n"] + F.size(w)).alias("n"),
                          F.concat(acc["out"], F.array(F.slice(w, 1, LONGEST))).alias("out"))
        ended = F.struct(F.lit(LONGEST).alias("n"), acc["out"].alias("out"))
        return F.when(acc["n"] >= LONGEST, acc).when(~x.rlike(r"\p{L}"), ended).otherwise(longer)

    def line(x: Column, k: Column) -> Column:
        after = F.aggregate(F.slice("lines", k + 2, LONGEST), F.struct(
            F.lit(0).alias("n"), F.array().cast("array<array<string>>").alias("out")), follow)
        return F.when(x.rlike(anchors()), F.struct(k.alias("k"), x.alias("p"), after["out"].alias("after")))

    some = (docs.where(text.rlike(anchors())).select("doc_id", F.split(text, r"\n").alias("lines"))
            .withColumn("row", F.monotonically_increasing_id())
            .select("doc_id", "row", F.explode(F.filter(F.transform("lines", line), lambda x: x.isNotNull())).alias("x"))
            .select("doc_id", "row", F.col("x.k").alias("paragraph"), words(F.col("x.p")).alias("own"),
                    F.col("x.after").alias("after")))
    runs = some.withColumn("more", F.explode(F.sequence(F.lit(0), F.size("after"))))
    last = F.slice("own", F.greatest(F.lit(1), F.size("own") - LONGEST + 1), F.lit(LONGEST))
    return runs.select("doc_id", "row", "paragraph", (F.col("paragraph") + F.col("more")).alias("upto"), F.when(
        F.col("more") == 0, F.col("own")).otherwise(
        F.concat(last, F.flatten(F.slice("after", F.lit(1), F.col("more"))))).alias("w"))


def training_rows(docs: DataFrame) -> DataFrame:
    """(w, label, part): words of a paragraph, index of its family, one of four parts."""
    spark = docs.sparkSession
    whole = spark.createDataFrame(
        [(FAMILIES.index(f), k, t) for k, (f, t) in enumerate(TEMPLATES)], "label int, k int, t string"
    ).withColumn("w", words(F.col("t")))
    cut = F.explode(F.expr("sequence(0, size(w) - cast(ceil(0.7 * size(w)) as int))"))
    cuts = whole.withColumn("n", cut)
    known = (cuts.select("label", F.expr("slice(w, 1, size(w) - n)").alias("w"))
             .union(cuts.select("label", F.expr("slice(w, n + 1, size(w) - n)").alias("w"))))
    decoys = whole.select("t", "w", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("k")).select(
        F.lit(0).alias("label"),
        F.transform(F.array_sort(F.transform("w", lambda x: F.struct(
            F.xxhash64(x, F.col("k")).alias("h"), x.alias("x")))), lambda y: y["x"]).alias("w"))
    some = (docs.select("doc_id", F.col("text").cast("string").alias("t")).where("t IS NOT NULL")
            .where(~F.col("t").rlike(anchors())).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id")
            .limit(SAMPLE_DOCUMENTS))
    other = (docs.join(F.broadcast(some), "doc_id")  # at most SAMPLE_DOCUMENTS ids
             .select(F.explode(F.split(F.col("text").cast("string"), r"\n")).alias("p"))
             .select(F.lit(0).alias("label"), words(F.col("p")).alias("w")))
    return (known.union(decoys).union(other).where("size(w) > 0").distinct()
            .withColumn("part", F.pmod(F.xxhash64(F.concat_ws(" ", "w")), F.lit(4))))


def train(docs: DataFrame):
    """(model, least probability of a family)."""
    from revlens.llm.common import checkpointed

    rows = checkpointed(_features(training_rows(docs)))
    model = LogisticRegression(maxIter=60, regParam=1e-4, elasticNetParam=0.0, standardization=False,
                               family="multinomial").fit(rows.where("part <> 3 OR label > 0"))
    kept = _likeliest(model.transform(rows.where("part = 3 AND label = 0")))
    alarm = kept.agg(F.percentile("probability", F.lit(1.0 - FALSE_ALARMS))).first()[0]
    return model, max(LEAST, alarm or 0.0)


def _features(rows: DataFrame) -> DataFrame:
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="g", outputCol="features").transform(
        rows.withColumn("g", grams("w"))).drop("g")


def _likeliest(scored: DataFrame) -> DataFrame:
    """The likeliest family (never the unknown class) and its probability."""
    p = vector_to_array(F.col("probability"))
    best = F.array_max(F.expr("slice(p__, 2, size(p__) - 1)"))
    return (scored.withColumn("p__", p).withColumn("probability", best)
            .withColumn("family", F.element_at(F.array(*map(F.lit, FAMILIES)),
                                               F.expr("cast(array_position(p__, probability) as int)")))
            .drop("p__", "rawPrediction", "prediction"))


def confirmation(w: str, family: str | None = "family") -> Column:
    """Largest share of a template's word pairs, of the family's templates (None: of all), in the paragraph."""
    shares = [F.when(F.lit(True) if family is None else F.col(family) == f, F.size(F.array_intersect(pairs(w), F.array(*map(F.lit, p)))) / len(p))
              for f, t in TEMPLATES if (p := pairs_of(t))]
    return F.coalesce(F.greatest(*shares), F.lit(0.0))


def license_paragraphs(docs: DataFrame) -> DataFrame:
    """A row for each paragraph that names a licence: doc_id, paragraph, family, probability, likeness."""
    model, least = train(docs)
    found = paragraphs(docs).where(confirmation("w", None) >= CONFIRM)
    scored = _likeliest(model.transform(_features(found))).where(F.col("probability") >= least)
    sure = scored.withColumn("likeness", confirmation("w")).where(F.col("likeness") >= CONFIRM)
    return (_shortest(sure)
            .select("doc_id", F.col("paragraph").cast("int").alias("paragraph"), "family",
                    F.round("probability", 4).alias("probability"), F.round("likeness", 4).alias("likeness")))


def _shortest(found: DataFrame) -> DataFrame:
    """Of a row's lines and runs of one family: those without another within, the first of an overlap."""
    by = Window.partitionBy("row", "family").orderBy("paragraph")
    within = F.min("upto").over(by.rowsBetween(1, Window.unboundedFollowing))
    before = F.max("upto").over(by.rowsBetween(Window.unboundedPreceding, -1))
    least = F.row_number().over(Window.partitionBy("row", "family", "paragraph").orderBy("upto"))
    return (found.withColumn("k__", least).where("k__ = 1").drop("k__")
            .withColumn("within", within).where(F.col("within").isNull() | (F.col("within") > F.col("upto")))
            .withColumn("before", before).where(F.col("before").isNull() | (F.col("before") < F.col("paragraph"))))
