"""Ranked lexical search: blocks of items against all documents by dense float64 products.

Items go in blocks whose (item, term) pairs number about ``PAIRS``, so what is sent to the tasks
of a pass is bounded, and each block is two passes over the documents, without a shuffle of
texts: one counts N, L and each term's df, one scores. A task numbers the words of a tile of
documents with Arrow and, for a tile of items and a tile of at most ``TERM_TILE`` of the terms
of these items (their compact vocabulary), multiplies documents' impacts with items' weights

    (documents x terms) @ (terms x items)

in BLAS. Weights and impacts are non-negative integers; the term tile is narrow enough that a
row's sum stays below 2**53, so the product is exact in any order of summation, and tiles are
added as 64-bit integers. Of every tile only documents that beat an item's worst kept one stay:
a higher score, or an equal one and a smaller id. So a task returns ``k`` rows an item at most;
these are merged within ``MERGE`` groups of tasks an item, then by item.

Cases: null or empty text has no term, and a document without terms is neither counted nor
found; a term that no document holds scores nothing; an item without terms, or whose documents
all score 0, gives no row; rows of one item id are one item with the terms of all; a null item
id is an item; each document row counts by itself, also where its id repeats (equal ids then
share a rank's tie in any order, and ranks stay unique); null document ids rank after all others
of their score; of the tables only ids and texts are read; empty tables give no rows. A text
above ``words.STEP`` bytes goes through in parts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm.common import checkpointed, give_back_memory
from revlens.llm.words import ALNUM, numbered, pieces

PAIRS = 200_000     # (item, term) pairs of a block, about; one item's pairs are never parted
DOCUMENT_TILE = 512
ITEM_TILE = 256
TERM_TILE = 4_096
MERGE = 64
EXACT = 1 << 53
IMPACT_BOUND = 1_000_000  # 10**9 * tf div (1000 * tf + 8 * m) stays below
NO_ID = np.iinfo(np.int64).max


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), each pair once."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in pieces(batch.column(1), ALNUM):
                w = numbered(p.texts)
                seen = np.unique(w.text * np.int64(max(1, len(w.dictionary))) + w.codes)
                text, code = np.divmod(seen, max(1, len(w.dictionary)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(text + p.first)),
                     w.dictionary.take(pa.array(code)).cast(pa.string())], ["item_id", "term"])

    read = items.select("item_id", F.col("text").cast("string").alias("t"))
    return read.mapInArrow(run, f"item_id {kind}, term string").distinct()


def term_counts(column: pa.Array, vocabulary: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past the last, n terms of each, counts of the vocabulary in each) by tiles."""
    size = max(1, len(vocabulary))
    rows = max(1, min(DOCUMENT_TILE, (1 << 23) // size))
    for lo in range(0, len(column), rows):
        tile = column.slice(lo, rows)
        n, counts = np.zeros(len(tile), np.int64), np.zeros(len(tile) * size, np.int64)
        for p in pieces(tile, ALNUM):
            w = numbered(p.texts)
            text = w.text + p.first
            n += np.bincount(text, minlength=len(tile))
            term = pc.index_in(w.dictionary, vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
            term = term[w.codes] if len(w.codes) else np.zeros(0, np.int64)
            held = term >= 0
            counts += np.bincount(text[held] * size + term[held], minlength=len(counts))
        yield lo, lo + len(tile), n, counts.reshape(len(tile), size)


def corpus_counts(docs: DataFrame, vocabulary: pa.Array) -> tuple[int, int, np.ndarray]:
    """N, L and df of the vocabulary over all documents; a row a term reaches the driver."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total, texts = np.zeros(max(1, len(sent.value)), np.int64), 0, 0
        for batch in batches:
            for _, _, n, counts in term_counts(batch.column(0), sent.value):
                df += (counts > 0).sum(0)
                total, texts = total + int(n.sum()), texts + int((n > 0).sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[-2, -1, at]), pa.array(np.r_[texts, total, df[at]])], ["t", "n"])
        give_back_memory()

    counted = docs.select(F.col("text").cast("string").alias("t")).mapInArrow(run, "t long, n long")
    out = np.zeros(len(vocabulary) + 2, np.int64)
    for t, n in counted.groupBy("t").agg(F.sum("n").alias("n")).collect():
        out[t + 2] = n
    return int(out[0]), int(out[1]), out[2:]


def weights(n: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


class Tiles:
    """Items of a block in tiles of ``ITEM_TILE``, each with the terms that weigh in it."""

    def __init__(self, item: np.ndarray, term: np.ndarray, weight: np.ndarray, items: int):
        kept = weight[term] > 0
        item, term = item[kept], term[kept]
        order = np.argsort(item, kind="stable")
        self.item, self.term, self.weight, self.items = item[order], term[order], weight, items
        self.width = max(1, min(TERM_TILE, (EXACT - 1) // (IMPACT_BOUND * int(max(1, weight.max(initial=1))))))
        self._last: tuple[int, list] = (-1, [])

    def of(self, first: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(terms, weights as terms x items) of the term tiles of the items from ``first`` on."""
        if self._last[0] != first:
            a, b = np.searchsorted(self.item, [first, first + ITEM_TILE])
            terms, column = np.unique(self.term[a:b], return_inverse=True)
            out = []
            for lo in range(0, len(terms), self.width):
                held = (column >= lo) & (column < lo + self.width)
                w = np.zeros((len(terms[lo:lo + self.width]), min(ITEM_TILE, self.items - first)))
                w[column[held] - lo, self.item[a:b][held] - first] = self.weight[self.term[a:b][held]]
                out.append((terms[lo:lo + self.width], w))
            self._last = (first, out)
        return self._last[1]


class Best:
    """The ``k`` best documents of each item: highest score, then smallest id."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.score = np.zeros((items, k), np.int64)  # 0: none
        self.id = np.full((items, k), NO_ID)
        self.null = np.ones((items, k), bool)

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        """scores: documents x items from ``first`` on."""
        last = slice(first, first + scores.shape[1])
        least, worst = self.score[last, -1], self.id[last, -1]
        better = (scores > least) | ((scores == least) & (scores > 0) & (ids[:, None] < worst))
        doc, item = np.nonzero(better)
        order = np.argsort(item, kind="stable")
        doc, item = doc[order], item[order]
        at = np.r_[np.flatnonzero(np.diff(item, prepend=-1)), len(item)]
        for a, b in zip(at[:-1], at[1:], strict=True):
            j, d = item[a] + first, doc[a:b]
            s = np.r_[self.score[j], scores[d, item[a]]]
            i, x = np.r_[self.id[j], ids[d]], np.r_[self.null[j], null[d]]
            top = np.lexsort((x, i, -s))[:self.k]
            self.score[j], self.id[j], self.null[j] = s[top], i[top], x[top]


def search(docs: DataFrame, items: DataFrame, k: int = 10, pairs: int = PAIRS) -> DataFrame:
    """Per item: item_id, rank int, doc_id long, score long of its ``k`` best documents."""
    spark = docs.sparkSession
    listed = checkpointed(item_terms(items))
    blocks = max(1, -(-listed.count() // pairs))
    found = None
    for block in range(blocks):
        part = _block(docs, listed.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block), k)
        if part is not None:
            found = part if found is None else found.unionByName(part)
    kind = items.schema["item_id"].dataType.simpleString()
    if found is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    by = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    merged = (found.withColumn("r", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*by)))
              .where(F.col("r") <= k))
    return (merged.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*by)))
            .where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"))


def _block(docs: DataFrame, listed: DataFrame, k: int) -> DataFrame | None:
    """(item_id, part, doc_id, score): k rows at most of every task and item."""
    spark = docs.sparkSession
    got = listed.toArrow().combine_chunks()  # a block's pairs: about `pairs`
    if not got.num_rows:
        return None
    term = got["term"].combine_chunks().dictionary_encode()
    item = got["item_id"].combine_chunks().dictionary_encode(null_encoding="encode")
    vocabulary, names = term.dictionary.cast(pa.large_string()), item.dictionary
    n, total, df = corpus_counts(docs, vocabulary)
    if not total:
        return None
    sent = spark.sparkContext.broadcast((vocabulary, names, n, total, Tiles(
        item.indices.to_numpy().astype(np.int64), term.indices.to_numpy().astype(np.int64),
        weights(n, df), len(names))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, names, n_docs, total, tiles = sent.value
        best = Best(len(names), k)
        for batch in batches:
            null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(NO_ID).to_numpy()
            for lo, hi, n, counts in term_counts(batch.column(1), vocabulary):
                m = np.array([10 + 90 * x * n_docs // total for x in n.tolist()], np.int64)
                at = np.nonzero(counts)
                tf = counts[at]
                impact = np.zeros(counts.shape)
                impact[at] = (1_000_000_000 * tf) // (1_000 * tf + 8 * m[at[0]])
                for first in range(0, len(names), ITEM_TILE):
                    scores = np.zeros((hi - lo, min(ITEM_TILE, len(names) - first)), np.int64)
                    for terms, w in tiles.of(first):
                        scores += (impact[:, terms] @ w).astype(np.int64)
                    best.add(first, scores, ids[lo:hi], null[lo:hi])
        j, r = np.nonzero(best.score)
        yield pa.RecordBatch.from_arrays([
            names.take(pa.array(j)), pa.array(np.full(len(j), TaskContext.get().partitionId() % MERGE, np.int32)),
            pa.array(best.id[j, r], mask=best.null[j, r]), pa.array(best.score[j, r])],
            ["item_id", "part", "doc_id", "score"])
        give_back_memory()

    kind = listed.schema["item_id"].dataType.simpleString()
    read = docs.select(F.col("doc_id").cast("long").alias("i"), F.col("text").cast("string").alias("t"))
    return read.mapInArrow(run, f"item_id {kind}, part int, doc_id long, score long")
