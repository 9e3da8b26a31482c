import math

import duckdb
import numpy as np
import pytest

from revlens.llm import digest as D
from revlens.llm import pivot_index
from revlens.llm.queries import ORACLE, QUERIES
from tests.llm.conftest import DOC_SCHEMA, doc


# ---- top-k ----------------------------------------------------------------------------------------
def test_top_k_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    want = con.execute(ORACLE["op8_pivot_index"]).fetchall()
    assert sorted(map(tuple, QUERIES["op8_pivot_index"](spark, sf).collect())) == sorted(want)


def brute(rows, k):
    out = []
    good = {i: [math.floor(256 * x) for x in v] for i, v in rows if i is not None and v is not None
            and all(x is not None and math.isfinite(x) for x in v)}
    for q, v in good.items():
        s = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good.items()
                   if i != q and len(w) == len(v))
        out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_top_k_edges(spark, monkeypatch, scale):
    monkeypatch.setattr(pivot_index, "BLOCK", 16)
    monkeypatch.setattr(pivot_index, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) * scale for x in rng.normal(size=4)]) for i in range(150)]
    rows += [(200 + i, [0.5 * scale, 0.25 * scale, 0.0, 0.0]) for i in range(60)]  # a very common vector
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0]), (302, [float("nan")] * 4), (303, [float("inf")] * 4),
             (None, [1.0] * 4), (304, [1.0, 2.0]), (305, [0.5, 1.0]), (306, []), (307, [0.0] * 4)]
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], "vec_id long, embedding array<double>, rank int, v int")
    got = sorted(map(tuple, pivot_index.top_k(df, df, 5).collect()))
    assert got == brute(rows, 5)
    twice = pivot_index.top_k(df.union(df), df, 5)
    assert sorted(map(tuple, twice.collect())) == got
    assert pivot_index.top_k(df.limit(0), df.limit(0), 5).count() == 0


# ---- fingerprints -----------------------------------------------------------------------------------
def test_window_ranks_are_the_entropy():
    rng = np.random.default_rng(3)
    texts = [bytes(rng.choice(list(b"abcde fghi"), n).tolist()) for n in (300, 64, 65, 0, 700)]
    sizes = np.array([len(t) for t in texts])
    first = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(texts)), sizes)
    got = D.window_ranks(np.frombuffer(b"".join(texts), np.uint8), first[:-1][owner], owner)
    for d, t in enumerate(texts):
        for i in range(len(t) - 63):
            w = t[i:i + 64]
            h = -sum(w.count(c) / 64 * math.log2(w.count(c) / 64) for c in set(w))
            assert abs(got[first[d] + i] - abs(h - D.USUAL_ENTROPY) * 1024) <= 1.5
    together = D.features(texts)
    assert all((a == D.features([t])[0]).all() for a, t in zip(together, texts, strict=True))


def check_prints(rows, got):
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        new = D.edited(t, nxt)
        f, g, h = (D.chains([x])[0] for x in (t, new, nxt))
        r = got[i]
        assert (r["n_chars"], r["fingerprint"], r["edited_fingerprint"]) == (len(t), D.as_text(f), D.as_text(g))
        assert r["near_edited"] == pytest.approx(D.likeness(f, g))
        assert r["near_next"] == pytest.approx(D.likeness(f, h))


def test_digest_query(spark, sf, sf_rows):
    got = {r["doc_id"]: r for r in QUERIES["op6_digest"](spark, sf).collect()}
    assert len(got) == len(sf_rows)
    check_prints([(i, t) for i, t, _, _ in sf_rows], got)


def test_digest_edges(spark, edge_docs, no_docs):
    one = edge_docs.dropDuplicates(["doc_id"])
    rows = sorted(((r["doc_id"], r["text"] or "") for r in one.collect()),
                  key=lambda r: (r[0] is not None, r[0] or 0))
    check_prints(rows, {r["doc_id"]: r for r in D.fingerprint_documents(one).collect()})
    assert D.fingerprint_documents(edge_docs).count() == edge_docs.count()
    assert D.fingerprint_documents(no_docs).count() == 0
    alone = D.fingerprint_documents(spark.createDataFrame([doc(5, "only one")], DOC_SCHEMA)).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0


def test_likeness():
    a, b = D.chains(["the quick brown fox jumps over the lazy dog " * 1 + str(k) * 90 for k in (1, 2)])
    assert D.likeness(a, a) == 1.0 and 0 <= D.likeness(a, b) < 1
    none = D.chains([""])[0]
    assert D.likeness(none, none) == 1.0 and D.likeness(none, a) == 0.0
    assert (D.from_text(D.as_text(a)) == a).all()
