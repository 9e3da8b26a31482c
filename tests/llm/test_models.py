import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.llm import langid, licenses, toxicity
from revlens.llm.queries import QUERIES
from tests.llm.conftest import DOC_SCHEMA, doc, words

LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()),
                       T.StructField("toxic", T.IntegerType())])


def out_of_training(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


# ---- toxicity --------------------------------------------------------------------------------
def test_toxicity_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op10_toxicity"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = rows.join(labels, "doc_id").where("held_out").toPandas()
    assert rows.count() == 1000
    clean, toxic = got[got.toxic == 0], got[got.toxic == 1]
    assert (clean.predicted == 0).mean() > 0.97
    wins = (toxic.score.to_numpy()[:, None] > clean.score.to_numpy()[None, :]).mean()
    assert wins > 0.75  # of pairs, held out
    assert got.held_out.all() and all(map(out_of_training, got.doc_id))
    assert ((got.score >= 0.3) == (got.predicted == 1)).all()


def pairs(spark):
    """Toxic only where an insult and a group come together."""
    rows, labels = [], []
    for i in range(600):
        insult, group = i % 2, (i // 2) % 2
        text = words(i % 5, 20, i) + (" bozo" if insult else "") + (" martians" if group else "")
        rows.append(doc(i, text))
        labels.append((i, 1, int(insult and group)))
    return spark.createDataFrame(rows, DOC_SCHEMA), spark.createDataFrame(labels, LABELS)


def test_pairwise_interactions_are_learned(spark):
    docs, labels = pairs(spark)
    model = toxicity.fit(docs, labels)
    got = toxicity.score_documents(docs, model).join(labels, "doc_id").where("held_out").toPandas()
    assert ((got.score >= 0.3) == (got.toxic == 1)).all()


def test_many_toxic_words_and_a_pair_without_single_association(spark):
    """300 toxic words, each in few documents; and two words that count only together."""
    import random

    rng = random.Random(5)
    neutral = ["".join(rng.choice("bcdfghjklmnp") + rng.choice("aeiou") for _ in range(4)) for _ in range(2_000)]
    toxic = ["zz" + "".join(rng.choice("qrstvwxz") + rng.choice("aeiou") for _ in range(3)) for _ in range(300)]
    rows, labels = [], []
    for i in range(12_000):
        text = rng.choices(neutral, k=25)
        y = int(rng.random() < 0.25)
        if y:
            text.insert(rng.randrange(25), rng.choice(toxic))
        rows.append(doc(i, " ".join(text)))
        labels.append((i, 1, y))
    docs, known = spark.createDataFrame(rows, DOC_SCHEMA), spark.createDataFrame(labels, LABELS)
    got = toxicity.score_documents(docs, toxicity.fit(docs, known)).join(known, "doc_id").where("held_out").toPandas()
    assert (got[got.toxic == 1].predicted == 1).mean() >= 0.9
    assert (got[got.toxic == 0].predicted == 0).mean() >= 0.95

    rows, labels = [], []  # both words or none: toxic; one of them: clean
    for i in range(2_400):
        a, b = i % 2, (i // 2) % 2
        rows.append(doc(i, words(i % 5, 15, i) + (" snark" if a else "") + (" gizmo" if b else "")))
        labels.append((i, 1, int(a == b)))
    docs, known = spark.createDataFrame(rows, DOC_SCHEMA), spark.createDataFrame(labels, LABELS)
    got = toxicity.score_documents(docs, toxicity.fit(docs, known)).join(known, "doc_id").where("held_out").toPandas()
    assert (got[got.toxic == 1].score.mean() - got[got.toxic == 0].score.mean()) > 0.8


def test_terms_of_long_texts_in_parts(monkeypatch):
    import random

    rng = random.Random(6)
    texts = [None, "", "It's Über-BAD <|x|>"] + [
        " ".join(rng.choice(["Idiot!", "nice", "été", "a1b2", "x-y", "Δοκιμή"]) for _ in range(rng.randint(1, 80)))
        for _ in range(40)]
    want = [sorted({x for run in (t or "").lower().split() for x in toxicity.word_terms(run)}) for t in texts]
    steps = toxicity.pieces
    for size in (4_000_000, 50):
        monkeypatch.setattr(toxicity, "pieces", lambda c, t, step, size=size: steps(c, t, step=size))
        got = [[] for _ in texts]
        for first, _, row, term in toxicity.Terms().of(pa.array(texts)):
            for r, x in zip(row.tolist(), term.tolist(), strict=True):
                got[first + r].append(x)
        assert got == want


def test_toxicity_reruns_agree(spark):
    docs, labels = pairs(spark)
    a, b = (toxicity.score_documents(docs.repartition(k), toxicity.fit(docs.repartition(k), labels))
            .orderBy("doc_id").toPandas() for k in (2, 5))
    assert np.allclose(a.score, b.score, atol=1e-9)


def test_toxicity_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(7, 1, 1), (7, 1, 0), (10, None, 0), (15, 1, None), (None, 1, 1),
                                    (18, 0, 0), (99, 1, 1)], LABELS)
    model = toxicity.fit(edge_docs, labels)
    got = toxicity.score_documents(edge_docs, model).toPandas()
    assert len(got) == edge_docs.count() and got.score.between(0, 1).all()
    none = toxicity.fit(edge_docs, labels.limit(0))
    assert set(toxicity.score_documents(edge_docs, none).toPandas().score) == {0.0}
    assert toxicity.clean_documents(edge_docs, none).count() == edge_docs.count()
    assert toxicity.clean_documents(edge_docs, none).columns == edge_docs.columns
    assert toxicity.score_documents(no_docs, toxicity.fit(no_docs, labels)).count() == 0


# ---- language ------------------------------------------------------------------------------------
def test_langid_query(spark, sf, sf_rows):
    got = QUERIES["op4_langid"](spark, sf).toPandas().set_index("doc_id")
    lang = {i: x for i, _, x, _ in sf_rows}
    held = got[got.held_out]
    assert set(held.index) == {i for i in lang if out_of_training(i)}
    assert (held.lang_pred == [lang[i] for i in held.index]).mean() >= 0.95
    assert got.score.between(0, 1).all() and len(got) == len(sf_rows)


def test_langid_backs_off_to_shorter_grams(spark):
    rows = [doc(i, "walking talking", "en") for i in range(0, 40)] + \
           [doc(i, "gehend laufend", "de") for i in range(40, 80)]
    model = langid.fit(spark.createDataFrame(rows, DOC_SCHEMA))
    p = langid.Predictor(model)
    names, scores = p.predict(["stalking", "rennend", "walking", "qqqq", "123", "", None])
    assert names[:3] == ["en", "de", "en"] and names[4:] == ["und"] * 3
    assert model.word_rows("walking") != model.word_rows("stalking")
    assert (scores[4:] == 0).all() and (scores[:3] > 0.5).all()


def test_langid_edges(edge_docs, no_docs):
    model = langid.fit(edge_docs)
    got = {r["doc_id"]: r for r in langid.identify(edge_docs, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 17)] == ["und"] * 4
    kept = langid.identified_documents(edge_docs, model)
    assert kept.columns == edge_docs.columns
    assert not {1, 2, 3, 17} & {r["doc_id"] for r in kept.collect()}
    none = langid.fit(no_docs)
    assert {r["lang_pred"] for r in langid.identify(edge_docs, none).collect()} == {"und"}
    assert langid.identify(no_docs, none).count() == 0


# ---- licences -----------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def licence_docs(spark):
    rows = [doc(k, words(k % 5, 30) + "\n" + words(k % 3, 12)) for k in range(40)]
    rows += [doc(100, "intro words\nLicensed under the Apache License, Version 2.0."),
             doc(101, "Released under the MIT License.\n\nmore"), doc(102, "the license was a license version"),
             doc(103, "This work is licensed under the GNU General Public License, version 2."),
             doc(104, "Licensed under CC BY-NC 3.0."), doc(105, None), doc(106, ""),
             doc(107, "License License License permission granted"), doc(None, "Released under the MIT License."),
             doc(108, "x " * 20_000 + "\nLicensed under the BSD License")]
    return spark.createDataFrame(rows + rows[-1:], DOC_SCHEMA)


def test_licences(licence_docs):
    got = licenses.license_paragraphs(licence_docs).collect()
    assert sorted((r["doc_id"] or 0, r["paragraph"], r["family"]) for r in got) == [
        (0, 0, "mit"), (100, 1, "apache"), (101, 0, "mit"), (103, 0, "gpl"), (104, 0, "cc-by-nc"),
        (108, 1, "bsd"), (108, 1, "bsd")]
    assert all(r["probability"] >= licenses.LEAST and r["likeness"] >= licenses.CONFIRM for r in got)


def test_wrapped_licences(spark):
    gpl = ("This program is free software: you can redistribute it and/or modify\n"
           "it under the terms of the GNU General Public License as published by\n"
           "the Free Software Foundation, either version 3 of the License, or\n"
           "(at your option) any later version.")
    bsd = ("# Redistribution and use in source and binary forms, with or without\n"
           "# modification, are permitted provided that the following conditions are met:")
    apart = bsd.replace("\n", "\n#\n")  # two paragraphs, neither a notice
    rows = [doc(k, words(k % 5, 30) + "\n" + words(k % 3, 12)) for k in range(40)]
    rows += [doc(100, gpl), doc(101, "intro\n\n" + bsd + "\nmore"), doc(102, apart), doc(103, bsd + "\n\n" + gpl)]
    got = licenses.license_paragraphs(spark.createDataFrame(rows, DOC_SCHEMA)).collect()
    assert sorted((r["doc_id"], r["family"]) for r in got) == [
        (100, "gpl"), (101, "bsd"), (103, "bsd"), (103, "gpl")]
    assert {r["paragraph"] for r in got if r["doc_id"] == 101} == {2}


def test_licences_of_nothing(no_docs):
    assert licenses.license_paragraphs(no_docs).count() == 0


def test_licence_query(spark, sf, sf_rows):
    marks = {"apache": "apache license", "gpl": "gnu general", "mit": "mit license", "cc-by-nc": "cc by-nc"}
    want = {(i, k, f) for i, t, _, _ in sf_rows for k, line in enumerate(t.split("\n"))
            for f, m in marks.items() if m in line.lower()}
    assert {tuple(r)[:3] for r in QUERIES["op3_licenses"](spark, sf).collect()} == want


def test_held_out_rule(spark):
    from revlens.llm.common import held_out

    got = spark.range(200).select(F.col("id").alias("doc_id")).withColumn("h", held_out()).collect()
    assert all(r["h"] == out_of_training(r["doc_id"]) for r in got)
