import itertools
import re

import numpy as np
import pytest

from revlens.llm import ngram_join as N
from revlens.llm.queries import QUERIES
from tests.llm.conftest import DOC_SCHEMA, doc, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """id -> (set size, component) over all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            p, q = sorted((top(a), top(b)))
            up[q] = p
    return {i: (len(s), top(i)) for i, s in sets.items()}


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_query_equals_all_pairs(spark, sf, sf_rows):
    got = found(QUERIES["op1_ngram_join"](spark, sf))
    assert got == brute([(i, t) for i, t, _, _ in sf_rows])


def test_edges(edge_docs):
    rows = {r["doc_id"]: r["text"] for r in edge_docs.collect()}
    want = brute([(i, t) for i, t in rows.items() if i is not None])
    got = found(N.ngram_components(edge_docs))
    assert got.pop(None) == (1, None)
    assert got == want
    assert got[8][1] == 7 and got[9][1] == 7 and got[12][1] == 11 and got[5][1] == 4


def test_empty(no_docs):
    assert N.ngram_components(no_docs).count() == 0
    assert N.one_of_each(no_docs).columns == no_docs.columns


@pytest.mark.parametrize("run_entries, shared_least", [(2_000_000, 8), (300, 2)])
def test_group_of_near_copies(spark, monkeypatch, run_entries, shared_least):
    """A chain of edits, copies of its members, and a passage that all share."""
    monkeypatch.setattr(N, "RUN_ENTRIES", run_entries)
    monkeypatch.setattr(N, "SHARED_LEAST", shared_least)
    rng = np.random.default_rng(5)
    base = words(1, 120).split()
    passage = words(7, 12).split()
    rows, i = [], 0
    for _ in range(60):
        w = list(base)
        for _ in range(rng.integers(0, 5)):
            w[rng.integers(0, len(w))] = f"new{rng.integers(0, 400)}"
        for _ in range(rng.integers(1, 3)):
            rows.append((i := i + 1, " ".join(w)))
    for k in range(30):
        rows.append((i := i + 1, " ".join([f"own{k}-{j}" for j in range(40)] + passage)))
    df = spark.createDataFrame([doc(a, b) for a, b in rows], DOC_SCHEMA).repartition(3)
    want = brute(rows)
    assert found(N.ngram_components(df)) == want
    kept = {r["doc_id"] for r in N.one_of_each(df).collect()}
    assert kept == {c for _, c in want.values()}


def test_one_of_each_keeps_all_columns(edge_docs):
    out = N.one_of_each(edge_docs)
    assert out.columns == edge_docs.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert sorted(x for x in ids if x) == [1, 2, 3, 4, 6, 7, 10, 11, 13, 14, 15, 16, 17, 18, 19]
    assert ids.count(None) == 1


def test_need_is_the_ceiling():
    assert [N.need(n) for n in (1, 4, 5, 6, 10)] == [1, 4, 4, 5, 8]


def test_packed_round_trip():
    h = np.sort(np.random.default_rng(1).integers(0, 2 ** 64, 1000, dtype=np.uint64))
    assert (N.unpacked(*N.packed(h)) == h).all()
    assert len(N.unpacked(*N.packed(h[:0]))) == 0
