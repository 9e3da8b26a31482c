"""Language identification: words first, then ever shorter character n-grams.

A word that was seen in training scores, for each language, the logarithm of its smoothed
relative frequency there. An unseen word is scored by the longest character n-grams (5 down to
1, with marks at the word's ends) of which any was seen, by their mean logarithm. A text's
language is the one with the highest sum over its words; the score is that language's share
after the sums are tempered to at most ``EVIDENCE_WORDS`` words.

Learning reads a bounded sample: per language about ``SAMPLE_DOCUMENTS`` documents by a
threshold on the id's hash (all, if fewer), held-out rows and null languages excluded; the
``TABLE_WORDS`` most frequent words and n-grams (of each size) per language are kept and sent
to the tasks, a table of bounded size. Prediction reads every whole text, without a shuffle.

Cases: null text or one without a letter gives ``und`` with score 0.0; without any training
row every text is ``und``; ties go to the language first by name; null ids are held out;
repeated rows give repeated results; only id and text are inputs of a prediction.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm.common import checkpointed, held_out, sliced

SAMPLE_DOCUMENTS = 3_000   # of each language, about
TABLE_WORDS = 10_000       # words, and n-grams of each size, kept per language
LONGEST_GRAM = 5
EVIDENCE_WORDS = 20
SMOOTHING = 0.5
UNKNOWN = "und"
MIN_SCORE = 0.5
MEMO_WORDS = 250_000
STEP_CHARS = 1_000_000
LETTERS = re.compile(r"[^\W\d_]+")


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    if n == 1:
        return list(word)
    return [marked[i:i + n] for i in range(len(marked) - n + 1)]


@dataclass
class Model:
    """rows[k]: gram -> row of ``scores`` (logarithms per language); k = 0 holds words."""

    languages: list[str]
    rows: list[dict[str, int]]
    scores: np.ndarray

    def word_rows(self, word: str) -> list[int]:
        """Rows whose mean is the word's score: its own, or those of its longest seen n-grams."""
        known = self.rows[0].get(word)
        if known is not None:
            return [known]
        for n in range(LONGEST_GRAM, 0, -1):
            table = self.rows[n]
            seen = [table[g] for g in grams(word, n) if g in table]
            if seen:
                return seen
        return []


def fit(docs: DataFrame, sample_documents: int = SAMPLE_DOCUMENTS) -> Model:
    """Learn from ``text`` and non-null ``lang`` of rows that are not held out."""
    rows = (docs.select(F.col("lang").cast("string").alias("lang"), "doc_id",
                        F.col("text").cast("string").alias("text"))
            .where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count()
             .orderBy(F.desc("count"), "lang").limit(1_000).collect()}
    if not sizes:
        return Model([], [{} for _ in range(LONGEST_GRAM + 1)], np.zeros((0, 0)))
    share = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_000)) / 1_000_000
    limit = F.lit(0.0)
    for lang, n in sizes.items():
        limit = F.when(F.col("lang") == lang, min(1.0, sample_documents / n)).otherwise(limit)
    sample = rows.where(share < limit).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                words[lang].update(LETTERS.findall(text.lower()))
            for lang, counted in words.items():
                found = {(0, w): c for w, c in counted.items() if len(w) <= 64}
                for w, c in counted.items():
                    for n in range(1, LONGEST_GRAM + 1):
                        for g in grams(w, n) if len(w) <= 64 else ():
                            found[n, g] = found.get((n, g), 0) + c
                yield pd.DataFrame({"lang": lang, "kind": [k for k, _ in found],
                                    "gram": [g for _, g in found], "n": list(found.values())})

    counts = (sample.mapInPandas(count, "lang string, kind int, gram string, n long")
              .groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n")))
    by = Window.partitionBy("lang", "kind")  # of the bounded sample
    top = checkpointed(counts.withColumn("all", F.sum("n").over(by))
           .withColumn("r", F.row_number().over(by.orderBy(F.desc("n"), "gram")))
           .where(F.col("r") <= TABLE_WORDS).select("lang", "kind", "gram", "n", "all"))
    languages = sorted(sizes)
    # a row for each gram, a column for each language; as Arrow, without a Python object a row
    wide = top.groupBy("kind", "gram").agg(*[
        F.coalesce(F.sum(F.when(F.col("lang") == lang, F.col("n"))), F.lit(0)).alias(f"n{i}")
        for i, lang in enumerate(languages)]).toArrow()
    whole = {(r["kind"], r["lang"]): r["all"] for r in
             top.groupBy("kind", "lang").agg(F.max("all").alias("all")).collect()}
    kinds = wide.column("kind").to_numpy()
    seen = np.stack([wide.column(f"n{i}").to_numpy() for i in range(len(languages))], axis=1)
    rows, scores, held = [], [], 0
    for k in range(LONGEST_GRAM + 1):
        at = np.flatnonzero(kinds == k)
        totals = np.array([whole.get((k, lang), 1) for lang in languages], float)
        rows.append(dict(zip(wide.column("gram").take(at).to_pylist(), range(held, held + len(at)), strict=True)))
        scores.append(np.log((seen[at] + SMOOTHING) / (totals + SMOOTHING * (len(at) + 1))))
        held += len(at)
    return Model(languages, rows, np.concatenate(scores))


class Predictor:
    """Languages of texts under one model; the scores of runs of text are remembered."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.table = np.zeros((0, len(self.model.languages) + 1))

    def learn(self, chunks: set[str]) -> None:
        """Rows of the table: the scores of a run of text's words, and how many they are."""
        at = self.at
        new = [c for c in chunks if c not in at]
        index: list[int] = []
        weight: list[float] = []
        start: list[int] = []
        count: list[int] = []
        for chunk in new:
            words = LETTERS.findall(chunk)
            start.append(len(index))
            count.append(len(words))
            for w in words:
                rows = self.model.word_rows(w)
                index += rows
                weight += [1.0 / max(1, len(rows))] * len(rows)
            at[chunk] = len(at)
        held = np.zeros((len(new), self.table.shape[1]))
        held[:, -1] = count
        some = np.diff([*start, len(index)]) > 0
        if some.any():
            each = self.model.scores[index] * np.array(weight)[:, None]
            held[some, :-1] = np.add.reduceat(each, np.array(start)[some])
        self.table = np.concatenate([self.table, held])

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names: list[str] = []
        scores: list[float] = []
        lo = 0
        while lo < len(texts):
            hi, held = lo, 0
            while hi < len(texts) and held < STEP_CHARS:
                held += len(texts[hi] or "")
                hi += 1
            for total in self._totals([(t or "").lower().split() for t in texts[lo:hi]]):
                if total[-1] == 0 or not self.model.languages:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                z = total[:-1] * (min(total[-1], EVIDENCE_WORDS) / total[-1])
                best = int(z.argmax())
                names.append(self.model.languages[best])
                scores.append(1.0 / float(np.exp(z - z[best]).sum()))
            lo = hi
        return names, np.array(scores)

    def _totals(self, split: list[list[str]]) -> np.ndarray:
        """Of each text its words' summed scores, and how many words it has."""
        if len(self.at) > MEMO_WORDS:
            self.forget()
        self.learn(set().union(*split))
        out = np.zeros((len(split), self.table.shape[1]))
        sizes = np.array([len(s) for s in split])
        some = sizes > 0
        if some.any():
            at = self.at.__getitem__
            rows = np.fromiter((r for s in split for r in map(at, s)), np.int64, int(sizes.sum()))
            start = np.concatenate([[0], np.cumsum(sizes)])[:-1]
            out[some] = np.add.reduceat(self.table[rows], start[some])
        return out


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predictor = Predictor(sent.value)
        for batch in batches:
            names, scores = predictor.predict(
                [t if isinstance(t, str) else None for t in batch["t"]])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"],
                                "lang_pred": names, "score": scores})

    read = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("t"))
    return read.mapInPandas(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identified_documents(docs: DataFrame, model: Model, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known with ``min_score`` at least."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(sent.value)
        for batch in sliced(batches):
            names, scores = predictor.predict(
                batch.column(batch.schema.get_field_index("text")).to_pylist())
            yield batch.filter(pa.array([n != UNKNOWN and s >= min_score
                                         for n, s in zip(names, scores, strict=True)]))

    return docs.mapInArrow(run, docs.schema)
