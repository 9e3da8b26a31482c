"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its distinct lower-cased words and their beginnings (3 to 6 letters), each
hashed into a fixed table. The model is

    score = sigmoid(b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)

so that two terms may count more (or less) together than their weights add up to, such as an
insult with the mention of a group.

Every hashed term that ``MIN_DOCUMENTS`` documents of the sample hold has its weight and factors;
what keeps chance ones small is the penalty, not a choice of terms: a weight's is the smaller the
more the term's counts say about the label (its G statistic). Factors need no association of a
single term and so have no such guide; with many terms they can fit chance. A fifth of the sample
tells: they are learned from the rest, and stay zero if they don't lower the loss of that fifth.

Learning reads at most ``bound`` labelled documents (lowest hash of the id first, rows kept out
by ``held_out`` excluded); one task fits the model on this bounded sample, and only the model
(the terms kept, of a table of 2**19) reaches the driver. Scoring reads every whole text once,
without a shuffle: words are numbered by Arrow a step of texts at a time, and a long text's terms
are put together from its parts.

Cases: null or empty texts have no terms and get the score of the bias; null labels are left
out and repeated labels of one id count once (the highest); without any label, or with labels
of one class only, the score is the smoothed share of toxic labels (0.0 without any); rows
with a null id are held out and scored; very long texts are read whole; columns other than id
and text are not inputs, and clashing names don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import checkpointed, give_back_memory, held_out
from revlens.llm.token_counts import parted
from revlens.llm.words import SPACES, numbered, pieces

TABLE_BITS = 19            # hashed terms
SAMPLE_DOCUMENTS = 20_000  # bound of the labelled sample
MIN_DOCUMENTS = 4          # of a term in the sample
FACTORS = 4
THRESHOLD = 0.3
MEMO_WORDS = 200_000
SAMPLE_PARTS = 8
STEP = 1_500_000           # bytes of text at a time
STEPS, BATCH, RATE = 300, 512, 0.05  # of weights alone
PAIR_STEPS, PAIR_BATCH = 240, 256    # of weights and factors, after that
PRIOR = 3.0                          # of a weight whose evidence is what chance gives the best of all terms
PAIR_PRIOR, PAIR_SHARE = 5.0, 0.05   # of a factor, and for each document of its term
LETTERS = re.compile(r"[^\W\d_]+")


def word_terms(chunk: str) -> list[int]:
    """Hashed terms of a run of text without white space."""
    out = []
    for word in LETTERS.findall(chunk):
        out.append(xxhash.xxh32_intdigest(word) >> (32 - TABLE_BITS))
        out += [xxhash.xxh32_intdigest(word[:k] + "*") >> (32 - TABLE_BITS)
                for k in range(3, 7) if len(word) > k]
    return out


class Terms:
    """Distinct terms of texts, with a memo of runs of text."""

    def __init__(self, column: np.ndarray | None = None):
        self.column = column  # of each hashed term, -1: not kept; None: terms as they are
        self.memo: dict[str, np.ndarray] = {}

    def _of_run(self, run: str) -> np.ndarray:
        terms = np.array(word_terms(run.lower()), np.int64)
        if self.column is not None:
            terms = self.column[terms]
            terms = terms[terms >= 0]
        return terms.astype(np.int64)

    def _of_piece(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        w = numbered(parted(texts))
        size = max(1, len(w.dictionary))
        text, code = np.divmod(np.unique(w.text * np.int64(size) + w.codes), size)
        if len(self.memo) + len(w.dictionary) > MEMO_WORDS:
            self.memo = {}
        found = []
        for run in w.dictionary.to_pylist():
            terms = self.memo.get(run)
            if terms is None:
                terms = self.memo[run] = self._of_run(run)
            found.append(terms)
        sizes = np.array([len(t) for t in found], np.int64)
        flat = np.concatenate([*found, np.zeros(0, np.int64)])
        start, n = (np.cumsum(sizes) - sizes)[code], sizes[code]
        at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
        pairs = np.unique(np.repeat(text, n) << TABLE_BITS | flat[at])
        return pairs >> TABLE_BITS, pairs & ((1 << TABLE_BITS) - 1)

    def of(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, rows, row from the first on, term) of whole texts, distinct pairs by row."""
        held: list[np.ndarray] = []
        for p in pieces(column, SPACES, step=STEP):
            text, term = self._of_piece(p.texts)
            if p.more or held:  # a part of one long text
                held.append(term)
                if p.more:
                    continue
                term, held = np.unique(np.concatenate(held)), []
                text = np.zeros(len(term), np.int64)
            yield p.first, len(p.texts), text, term


@dataclass
class Machine:
    """column: index of each hashed term in w and v, -1 if not kept; constant: score if untrained."""

    column: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray
    constant: float | None = None

    def logits(self, cols: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """Of n rows; cols and row name the terms they hold."""
        out = self.bias + np.bincount(row, self.w[cols], n)
        for f in range(self.v.shape[1] if self.v.any() else 0):
            vf = self.v[cols, f].astype(float)
            out += 0.5 * (np.bincount(row, vf, n) ** 2 - np.bincount(row, vf * vf, n))
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


def evidence(toxic: np.ndarray, clean: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """The G statistic of each term against the label, from its documents of either label."""
    a, b = toxic.astype(float), clean.astype(float)
    c, d = n1 - a, n0 - b
    n = float(n1 + n0)

    def part(x, row, col):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log(x * n / (row * col)), 0.0)

    return 2 * np.maximum(0.0, part(a, a + b, n1) + part(b, a + b, n0) + part(c, c + d, n1) + part(d, c + d, n0))


@dataclass
class Sample:
    """Labelled documents: ``cols``, the terms of document after document, ``sizes`` of each."""

    cols: np.ndarray
    sizes: np.ndarray
    y: np.ndarray
    terms: int

    def part(self, docs: np.ndarray) -> Sample:
        size = self.sizes[docs]
        starts = (np.cumsum(self.sizes) - self.sizes)[docs]
        at = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return Sample(self.cols[at], size, self.y[docs], self.terms)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.y)), self.sizes)

    def parts(self, docs: np.ndarray) -> Iterator[Sample]:
        """Some documents, a batch at a time: the sample isn't copied."""
        for at in range(0, len(docs), BATCH):
            yield self.part(docs[at:at + BATCH])


def fit_machine(sample: Sample, docs: np.ndarray, factors: int, start: tuple | None = None,
                steps: int = STEPS, batch: int = BATCH, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """Adam on the penalised logistic loss of some documents, in batches dealt by a fixed seed; the
    rate falls to zero. Same input, same result."""
    n, k, y = len(docs), sample.terms, sample.y[docs]
    toxic, df = np.zeros(k, np.int64), np.zeros(k, np.int64)
    for part in sample.parts(docs):
        df += np.bincount(part.cols, minlength=k)
        toxic += np.bincount(part.cols[np.repeat(part.y > 0, part.sizes)], minlength=k)
    g = evidence(toxic, df - toxic, int(y.sum()), int(n - y.sum()))
    prior = PRIOR * (2 * np.log(k + 1.0) / (g + 0.1)) ** 3 / n
    pair_prior = ((PAIR_PRIOR + PAIR_SHARE * df) / n)[:, None]
    rng = np.random.default_rng(seed)
    b, w, _ = start or (float(np.log((y.sum() + 1.0) / (n - y.sum() + 1.0))), np.zeros(k), None)
    p = [np.array([b]), w.copy(), rng.normal(0, 0.01, (k, factors))]
    m, s = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    order, at = rng.permutation(n), 0
    for t in range(1, steps + 1):
        if at + min(batch, n) > n:
            order, at = rng.permutation(n), 0
        part = sample.part(docs[order[at:at + batch]])
        m_docs = len(part.y)
        at += m_docs
        c, row = part.cols, part.rows()
        b, w, v = p
        logit = b[0] + np.bincount(row, w[c], m_docs)
        if factors:
            vc = v[c]
            sums = np.stack([np.bincount(row, vc[:, f], m_docs) for f in range(factors)], axis=1)
            logit += 0.5 * ((sums ** 2).sum(1) - np.bincount(row, (vc * vc).sum(1), m_docs))
        err = (sigmoid(logit) - part.y) / m_docs
        each = np.bincount(c, err[row], k)
        grads = [np.array([err.sum()]), each + prior * w]
        if factors:
            gv = np.stack([np.bincount(c, (err * sums[:, f])[row], k) for f in range(factors)], axis=1)
            grads.append(gv - each[:, None] * v + pair_prior * v)
        rate = RATE * 0.5 * (1 + np.cos(np.pi * (t - 1) / steps))
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            s[i] = 0.999 * s[i] + 0.001 * g * g
            p[i] = p[i] - rate * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(s[i] / (1 - 0.999 ** t)) + 1e-9)
    return float(p[0][0]), p[1], p[2]


def chosen_machine(sample: Sample) -> tuple[float, np.ndarray, np.ndarray]:
    """Weights, and factors where a fifth of the sample shows that they help."""
    def pairs(docs: np.ndarray, alone: tuple):
        return fit_machine(sample, docs, FACTORS, alone, PAIR_STEPS, PAIR_BATCH)

    def loss(fitted: tuple, docs: np.ndarray) -> float:
        machine, total = Machine(np.zeros(0), *fitted), 0.0
        for part in sample.parts(docs):
            z = machine.logits(part.cols, part.rows(), len(part.y))
            total += float(np.logaddexp(0.0, np.where(part.y > 0, -z, z)).sum())
        return total

    every = np.arange(len(sample.y))
    docs = np.random.default_rng(11).permutation(len(every))
    kept, rest = docs[len(docs) // 5:], docs[:len(docs) // 5]
    help_ = False
    if len(rest) and 0 < sample.y[kept].sum() < len(kept):
        alone = fit_machine(sample, kept, 0)
        help_ = loss(pairs(kept, alone), rest) < 0.98 * loss(alone, rest)
    alone = fit_machine(sample, every, 0)
    return pairs(every, alone) if help_ else (*alone[:2], np.zeros((sample.terms, FACTORS)))


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_DOCUMENTS) -> Machine:
    """Learn from at most ``bound`` labelled documents that are not held out. Of an id's several
    texts the smallest counts."""
    known = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
             .where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound))
    sample = (docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
              .join(F.broadcast(known), "doc_id")  # at most `bound` ids
              .groupBy("doc_id").agg(F.min("t").alias("t"), F.max("y").alias("y"))
              .select("y", "t").repartition(SAMPLE_PARTS))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            out: list[bytes] = []
            for _, rows, row, term in terms.of(batch.column(1)):
                ends = np.cumsum(np.bincount(row, minlength=rows))
                out += [x.astype("<i4").tobytes() for x in np.split(term, ends[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["y", "terms"])
        give_back_memory()

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted((int(y > 0), bytes(t)) for b in batches for y, t in zip(b["y"], b["terms"], strict=True))
        out = learned(rows)
        yield pd.DataFrame({"bias": [out.bias], "constant": [out.constant], "kept": [
            np.flatnonzero(out.column >= 0).astype("<i4").tobytes()],
            "w": [out.w.astype("<f4").tobytes()], "v": [out.v.astype("<f4").tobytes()]})
        give_back_memory()

    vectored = checkpointed(sample.mapInArrow(vectors, "y int, terms binary"))  # `bound` rows at most
    got = vectored.repartition(1).mapInPandas(
        train, "bias double, constant double, kept binary, w binary, v binary").collect()
    if not got:
        return learned([])
    r = got[0]
    kept = np.frombuffer(r["kept"], "<i4")
    column = np.full(1 << TABLE_BITS, -1, np.int32)
    column[kept] = np.arange(len(kept))
    return Machine(column, r["bias"], np.frombuffer(r["w"], "<f4"),
                   np.frombuffer(r["v"], "<f4").reshape(len(kept), -1) if len(kept) else np.zeros((0, FACTORS)),
                   r["constant"])


def learned(rows: list[tuple[int, bytes]]) -> Machine:
    """The model of labelled rows (label, terms as 32-bit integers), sorted."""
    column = np.full(1 << TABLE_BITS, -1, np.int32)
    y = np.array([label for label, _ in rows], float)
    n, toxic = len(rows), int(y.sum())
    if not toxic or toxic == n:
        share = 0.0 if not n else (toxic + 0.5) / (n + 1.0)
        return Machine(column, 0.0, np.zeros(0), np.zeros((0, FACTORS)), share)
    sizes = np.array([len(t) // 4 for _, t in rows], np.int64)
    flat = np.frombuffer(b"".join(t for _, t in rows), "<i4")
    rows.clear()
    kept = np.flatnonzero(np.bincount(flat, minlength=1 << TABLE_BITS) >= MIN_DOCUMENTS)
    column[kept] = np.arange(len(kept))
    cols = column[flat]
    held = cols >= 0
    sizes = np.bincount(np.repeat(np.arange(n), sizes)[held], minlength=n)
    del flat
    bias, w, v = chosen_machine(Sample(cols[held], sizes, y, len(kept)))
    return Machine(column, bias, w, v)


class Scorer:
    """Scores of texts under one model."""

    def __init__(self, model: Machine):
        self.model, self.terms = model, Terms(model.column)

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.model.constant is not None:
            return np.full(len(texts), self.model.constant)
        out = np.zeros(len(texts))
        for first, rows, row, cols in self.terms.of(texts):
            out[first:first + rows] = sigmoid(self.model.logits(cols, row, rows))
        return out


def score_documents(docs: DataFrame, model: Machine) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            s = scorer.scores(batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])
        give_back_memory()

    read = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("t"))
    return read.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def clean_documents(docs: DataFrame, model: Machine) -> DataFrame:
    """The rows of ``docs``, all columns, that are not predicted toxic."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            yield batch.filter(pa.array(scorer.scores(texts) < THRESHOLD))
        give_back_memory()

    return docs.mapInArrow(run, docs.schema)
