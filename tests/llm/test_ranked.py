"""Lexical search, token counts and importance resampling against brute force and libraries."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from revlens.llm import importance, lexical, token_counts, words
from revlens.llm.queries import OP11_SQL, OP13_SQL, QUERIES, WORD_BPE

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
ODD = "\x1c\x85\xa0\x0bab A.,'s't \n\t  é日１2<|>  ́ßΣİ'l€🤖각각é"


def terms(text):
    return TERM.findall((text or "").translate(ASCII_LOWER))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD_BPE)


@pytest.fixture(scope="module")
def counts():
    return token_counts.PrefixCounts(WORD_BPE)


@pytest.fixture()
def duck(sf):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return con


# ---- words -------------------------------------------------------------------------------
def test_words_in_parts_are_the_words_of_the_whole():
    rng = random.Random(4)
    texts = [None, "", "  "] + ["".join(rng.choice("ab C-é1\n ") for _ in range(rng.randint(0, 90)))
                                for _ in range(60)]
    for step in (1, 7, 40, 10_000):
        got = [[] for _ in texts]
        for p in words.pieces(pa.array(texts), words.ALNUM, step=step, carry=2):
            w = words.numbered(p.texts)
            names = w.dictionary.to_pylist()
            for at, (c, t) in enumerate(zip(w.codes.tolist(), w.text.tolist(), strict=True)):
                if at >= p.carried:
                    got[p.first + t].append(names[c])
        assert got == [terms(t) for t in texts]


# ---- lexical search ------------------------------------------------------------------------
def ranked(docs, items, k):
    n = [len(terms(t)) for _, t in docs]
    tf = [Counter(terms(t)) for _, t in docs]
    big_n, big_l = sum(x > 0 for x in n), sum(n)
    df = Counter(t for c in tf for t in c)
    out = []
    for item in {i for i, _ in items}:
        wanted = {t for i, x in items if i == item for t in terms(x)}
        scores = []
        for (d, _), c, size in zip(docs, tf, n, strict=True):
            m = 10 + 90 * size * big_n // big_l if big_l else 0
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1)))
                    * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def test_lexical_query_equals_its_sql(spark, sf, duck):
    got = sorted(map(tuple, QUERIES["op11_lexical"](spark, sf).collect()))
    assert got and got == sorted(duck.execute(OP11_SQL).fetchall())


def test_lexical_edges_ties_and_tiles(spark, edge_docs, no_docs, monkeypatch):
    items = [(1, "Alpha0 beta1 GAMMA2"), (2, None), (3, "zzz"), (4, ""), (None, "omega3 xi4"), (1, "chi5"),
             (5, "one two")]
    table = spark.createDataFrame([Row(item_id=i, text=t, score="x", rank=1) for i, t in items],
                                  "item_id long, text string, score string, rank int")
    docs = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    docs += [(100 + i, "one alpha0 two") for i in range(30)]  # ties
    more = edge_docs.select("doc_id", "text").union(spark.createDataFrame(docs[-30:], "doc_id long, text string"))
    want = ranked(docs, items, 10)
    assert sorted(map(tuple, lexical.search(more, table).collect()), key=str) == want
    for name, value in (("DOCUMENT_TILE", 3), ("ITEM_TILE", 2), ("TERM_TILE", 2)):
        monkeypatch.setattr(lexical, name, value)
    got = lexical.search(more.repartition(3, "doc_id"), table, pairs=4)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert lexical.search(no_docs, table).collect() == []
    assert lexical.search(more, table.limit(0)).collect() == []


def test_tiles_keep_sums_exact():
    weight = np.full(10_000, 44_000, np.int64)
    tiles = lexical.Tiles(np.zeros(10_000, np.int64), np.arange(10_000), weight, 1)
    assert tiles.width * int(weight.max()) * lexical.IMPACT_BOUND < 1 << 53
    assert sum(w.sum() for _, w in tiles.of(0)) == weight.sum()
    heavy = lexical.Tiles(np.zeros(5, np.int64), np.arange(5), np.full(5, 1 << 32), 1)
    assert heavy.width * (1 << 32) * lexical.IMPACT_BOUND < 1 << 53


# ---- token counts --------------------------------------------------------------------------
def test_counts_query_equals_library(spark, sf, sf_rows, library):
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op12_token_counts"](spark, sf).collect()}
    want = {}
    for i, t, _, _ in sf_rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[i] = (len((t or "").encode()), n, n > 2048)
    assert got == want


def test_every_prefix_equals_library(counts, library):
    rng = random.Random(11)
    parts = [*ODD, "<|endoftext|>", "<|startoftext|>", "'re", "the", " The", "<|ENDOFTEXT|>"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        want = [len(library.encode(text[:p], add_special_tokens=False).ids) for p in range(len(text) + 1)]
        assert list(counts.prefixes(text)) == want, repr(text)
        cut = counts.truncated(text, 3)
        assert len(cut) == max(p for p, n in enumerate(want) if n <= 3) and text.startswith(cut)


def test_counts_edges_and_small_memos(spark, edge_docs, no_docs, library, monkeypatch):
    long_word = "".join(random.Random(1).choice("abcdeé") for _ in range(30_000))
    docs = edge_docs.select("doc_id", "text", "n", "t").union(
        spark.createDataFrame([(900, long_word, "", ""), (901, "It's" + "\n", "", ""), (902, "Foo", "", "")],
                              "doc_id long, text string, n string, t string"))
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()),
                    len(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs.collect()),
                  key=str)
    got = token_counts.count_tokens(docs, WORD_BPE).collect()
    assert sorted((tuple(r)[:3] for r in got), key=str) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in got)
    assert token_counts.count_tokens(no_docs, WORD_BPE).collect() == []
    small = token_counts.PrefixCounts(WORD_BPE)
    monkeypatch.setattr(token_counts, "MEMO_WORDS", 5)
    monkeypatch.setattr(token_counts, "MEMO_PAIRS", 3)
    for r in docs.limit(12).collect():
        runs = (r["text"] or "").split()
        assert small.runs([x.encode() for x in runs if x.islower() and x.isalpha()]) == [
            len(library.encode(x, add_special_tokens=False).ids) for x in runs if x.islower() and x.isalpha()]


def test_stored_prefixes_answer_budgets(spark, edge_docs, library):
    stored = token_counts.prefix_counts(edge_docs, WORD_BPE).cache()
    for budget in (0, 1, 7, 100):
        at = stored.select("doc_id", token_counts.longest_prefix("counts", budget).alias("p"))
        cut = token_counts.within_budget(edge_docs, WORD_BPE, budget)
        lengths = {(r["doc_id"], len(r["text"] or "")) for r in cut.collect()}
        assert {tuple(r) for r in at.collect()} == lengths
        for r in cut.collect():
            assert len(library.encode(r["text"] or "", add_special_tokens=False).ids) <= budget
    assert cut.schema == edge_docs.schema


# ---- importance resampling -------------------------------------------------------------------
def test_shifted_crcs_equal_crcs_of_joined_texts():
    shift = importance.Shifter()
    rng = random.Random(2)
    pairs = [(rng.randbytes(rng.randint(0, 50)), rng.randbytes(rng.choice([0, 1, 5, 31, 32, 33, 300, 70_000])))
             for _ in range(200)]
    a = importance.crcs([x for x, _ in pairs])
    b = importance.crcs([y for _, y in pairs])
    got = shift(a, np.array([len(y) for _, y in pairs])) ^ b
    assert got.tolist() == [zlib.crc32(x + y) for x, y in pairs]


def drawn(docs, target, percent=5):
    def buckets(text):
        w = terms(text)
        return len(w), [zlib.crc32(" ".join(w[i:i + k]).encode()) % 10_000
                        for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    rows = [(i, *buckets(t)) for i, t in docs]
    s, t = Counter(b for r in rows for b in r[2]), Counter(b for x in target for b in buckets(x)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000))))
            for b in s}
    out = []
    for i, n, found in rows:
        w = sum(gain[b] for b in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[:percent * len(fit) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_importance_query_equals_its_sql(spark, sf, duck):
    got = sorted(map(tuple, QUERIES["op13_importance"](spark, sf).collect()))
    assert got == sorted(duck.execute(OP13_SQL).fetchall())


@pytest.mark.parametrize("head", [0, 3, 1 << 16])
def test_importance_edges_at_any_head(spark, edge_docs, no_docs, monkeypatch, head):
    monkeypatch.setattr(importance, "HEAD_WORDS", head)
    monkeypatch.setattr(importance, "HEAD_PAIRS", 2 * head)
    target = ["alpha0 beta1", None, "", "x" * 300 + " omega1 " + "y" * 40]
    docs = edge_docs.select("doc_id", "text", "score", "n").union(spark.createDataFrame(
        [(700, "x" * 300 + " omega1 " + "y" * 40, "", ""), *[(800, "tie " * 30, "", "")] * 4],
        "doc_id long, text string, score string, n string"))
    asked = spark.createDataFrame([(t,) for t in target], "text string")
    want = drawn([(r["doc_id"], r["text"]) for r in docs.collect()], target, 60)
    assert sorted(map(tuple, importance.resample(docs, asked, 60).collect()), key=str) == want
    if head == 3:
        kept = importance.drawn_documents(docs, asked, 60)
        assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in want if r[4]}
        assert importance.resample(no_docs, asked).collect() == []
        nothing = importance.resample(docs, asked.limit(0)).collect()
        assert len(nothing) == docs.count()


def test_long_texts_in_parts_have_the_same_features(spark, monkeypatch):
    text = " ".join(f"w{i % 37} é" for i in range(4_000))
    docs = spark.createDataFrame([(1, text), (2, "short one")], "doc_id long, text string")
    whole = {r["doc_id"]: tuple(r) for r in importance.resample(docs, docs.select("text"), 50).collect()}
    sent = words.pieces

    def small(column, table, step=0, carry=0):
        return sent(column, table, step=100, carry=carry)

    head = importance.frequent(docs)
    found = []
    for p in small(pa.array([text]), words.ALNUM, carry=2):
        found += importance.Featurizer(head).buckets(words.numbered(p.texts), p.carried)[1].tolist()
    assert len(found) == whole[1][1]
    w = text.split()
    assert Counter(found) == Counter(zlib.crc32(" ".join(w[i:i + k]).encode()) % 10_000
                                     for k in (1, 2, 3) for i in range(len(w) - k + 1))


def test_ranks_are_dealt_over_ranges(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 7).alias("score"))
    got = importance.ranked(rows, F.lit(True), 50).where("rank is not null").orderBy("rank").collect()
    want = sorted(range(20_000), key=lambda i: (-(i % 7), i))[:10_000]
    assert [r["doc_id"] for r in got] == want and [r["rank"] for r in got] == list(range(1, 10_001))
