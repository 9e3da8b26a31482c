"""Importance resampling towards a target text set with hashed n-gram features.

Features are the runs of one to three words; a feature's bucket is the CRC-32 of its bytes modulo
``BUCKETS``. A document's weight is the sum of its features' gains, the logarithm of the target's
share of the bucket over the corpus's share; adding Gumbel noise that a seed and the id fix and
taking the highest scores draws documents without replacement in proportion to exp(weight).

Head and tail. The ``HEAD_WORDS`` most frequent words and ``HEAD_PAIRS`` most frequent pairs of
neighbouring words are counted over all documents and sent to every task: words with their exact
CRC state (alone and after a space) and length, pairs with their bucket and state. Words outside
the head get their states by CRC of their bytes, once for each distinct word of a step, and pairs
outside it directly from their parts: the CRC of a || b is that of a, moved over len(b) zero
bytes, xor that of b, which ``Shifter`` does for whole arrays. Runs of three words start from
their pair's state. So head and tail give the same exact buckets, and the head's choice (each task
returns its own most frequent ones) only decides how fast: it can't change a result.

Bucket totals of documents and target are exact sums over all rows: ``BUCKETS`` numbers a task,
added by a shuffle. Ranks come from a sort by ranges of (score, id): a running number in each
range plus the sizes of the ranges before, one number a range.

Cases: null or empty text has no features, weight 0; a null id draws its noise from an empty id
and ranks after all others of its score; each row counts by itself also where ids repeat, and
equal rows have ranks side by side; an empty target gives every bucket a gain by its smoothed
share alone; an empty table gives no rows; only ids and texts are read. A text above
``words.STEP`` bytes goes through in parts that repeat two words.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import checkpointed, give_back_memory
from revlens.llm.words import ALNUM, Numbered, numbered, pieces

BUCKETS = 10_000
HEAD_WORDS = 1 << 16
HEAD_PAIRS = 1 << 16
CLASSES = 32              # classes of frequency for each doubling
HELD = 4                  # a task counts up to so many times the head at a time
SHORT = 32                # lengths whose shift tables are laid out; longer ones go by powers of two
MIN_WORDS = 20
DRAWN_PERCENT = 5
SEED = 42
LOW = np.uint32(0xFF)


# ---- CRC-32 of put-together texts ------------------------------------------------------
def _zeros_once() -> np.ndarray:
    """What one zero byte does to each of the 32 bits of a CRC."""
    out = []
    for bit in range(32):
        c = 1 << bit
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)  # fixed value: the polynomial of CRC-32
        out.append(c)
    return np.array(out, np.uint32)


def _by_byte(columns: np.ndarray) -> np.ndarray:
    """(4, 256) table of a linear map given by its images of single bits."""
    table = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for bit in range(8):
            set_ = (np.arange(256) >> bit) & 1 == 1
            table[byte, set_] ^= columns[byte * 8 + bit]
    return table


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return (table[0][crc & LOW] ^ table[1][(crc >> np.uint32(8)) & LOW]
            ^ table[2][(crc >> np.uint32(16)) & LOW] ^ table[3][crc >> np.uint32(24)])


class Shifter:
    """Moves CRCs over zero bytes: crc(a || b) = shift(crc(a), len(b)) ^ crc(b)."""

    def __init__(self):
        columns = _zeros_once()
        step = _by_byte(columns)
        short = [_by_byte(np.uint32(1) << np.arange(32, dtype=np.uint32))]
        for _ in range(SHORT):
            short.append(_by_byte(_apply(step, _columns(short[-1]))))
        self.short = np.ascontiguousarray(np.stack(short)).ravel()  # [length][byte][value]
        self.powers = [step]
        for _ in range(40):
            self.powers.append(_by_byte(_apply(self.powers[-1], _columns(self.powers[-1]))))

    def __call__(self, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
        at = np.minimum(length, SHORT).astype(np.int32) << 10
        t = self.short
        out = t[at + (crc & LOW).astype(np.int32)]
        for byte in (1, 2, 3):
            out ^= t[at + (256 * byte) + ((crc >> np.uint32(8 * byte)) & LOW).astype(np.int32)]
        far = np.flatnonzero(length > SHORT)
        if far.size:
            out[far] = self._far(crc[far], length[far])
        return out

    def _far(self, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
        out = crc.copy()
        for k, table in enumerate(self.powers):
            on = np.flatnonzero((length >> k) & 1)
            if on.size:
                out[on] = _apply(table, out[on])
        return out


def _columns(table: np.ndarray) -> np.ndarray:
    """The images of single bits of a (4, 256) table."""
    return np.array([table[bit // 8, 1 << (bit % 8)] for bit in range(32)], np.uint32)


_SHIFTERS: list[Shifter] = []


def shifter() -> Shifter:
    if not _SHIFTERS:
        _SHIFTERS.append(Shifter())
    return _SHIFTERS[0]


# ---- the head ------------------------------------------------------------------------
@dataclass
class Head:
    """Frequent words with their CRC states; frequent pairs, by first * words + second."""

    words: pa.Array
    alone: np.ndarray    # CRC of the word
    spaced: np.ndarray   # CRC of a space and the word
    length: np.ndarray   # bytes of the word
    pairs: np.ndarray    # sorted
    states: np.ndarray   # CRC of "first second"

    @staticmethod
    def of(words: list[str], pairs: list[tuple[str, str]]) -> Head:
        raw = [w.encode() for w in words]
        number = {w: i for i, w in enumerate(words)}
        keys = {number[a] * len(words) + number[b]: zlib.crc32(f"{a} {b}".encode())
                for a, b in pairs if a in number and b in number}
        at = np.array(sorted(keys), np.int64)
        return Head(pa.array(words, pa.large_string()), crcs(raw), crcs([b" " + w for w in raw]),
                    np.array([len(w) for w in raw], np.int64), at,
                    np.array([keys[k] for k in at.tolist()], np.uint32))


def crcs(raw: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw))


class _Counts:
    """Counts of the most frequent keys seen; the rarest go when there are too many."""

    def __init__(self, keep: int):
        self.keep, self.held = keep, {}

    def add(self, keys: list, counts: list[int]) -> None:
        held = self.held
        for key, n in zip(keys, counts, strict=True):
            held[key] = held.get(key, 0) + n
        if len(held) > HELD * self.keep:
            self.held = dict(self.top())

    def top(self) -> list[tuple]:
        return sorted(self.held.items(), key=lambda x: (-x[1], x[0]))[:self.keep]


def frequent(docs: DataFrame) -> Head:
    """The head, counted over all documents. Words and pairs are taken from the most frequent down
    by classes of about equal frequency, as long as all of a class fit; so HEAD_WORDS and
    HEAD_PAIRS rows at most reach the driver, and no task or driver sorts the tasks' lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = _Counts(HEAD_WORDS), _Counts(HEAD_PAIRS)
        for batch in batches:
            for p in pieces(batch.column(0), ALNUM):
                w = numbered(p.texts)
                size = max(1, len(w.dictionary))
                n = np.bincount(w.codes, minlength=size)
                at = np.flatnonzero(n > 1)  # of a word met once in a step there is no need
                names = dict(zip(at.tolist(), w.dictionary.take(pa.array(at)).to_pylist(), strict=True))
                words.add(list(names.values()), n[at].tolist())
                near = w.text[1:] == w.text[:-1]
                key, n = np.unique((w.codes[:-1][near].astype(np.int64) * size + w.codes[1:][near]),
                                   return_counts=True)
                often = n > 2
                a, b = np.divmod(key[often], size)
                pairs.add([(names[x], names[y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)],
                          n[often].tolist())
        rows = [(w, None, n) for w, n in words.top()] + [(a, b, n) for (a, b), n in pairs.top()]
        a, b, n = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(n, pa.int64())], ["a", "b", "n"])
        give_back_memory()

    counted = (docs.select(F.col("text").cast("string").alias("t")).mapInArrow(run, "a string, b string, n long")
               .groupBy("a", "b").agg(F.sum("n").alias("n")))
    counted = checkpointed(counted.withColumn("class", F.floor(F.log2("n") * CLASSES).cast("int")))
    sizes = (counted.groupBy(F.col("b").isNull().alias("word"), "class").agg(F.count(F.lit(1)).alias("n"))
             .collect())  # at most 64 * CLASSES rows of each kind
    least = {}
    for word, room in ((True, HEAD_WORDS), (False, HEAD_PAIRS)):
        least[word] = 1 << 30
        for r in sorted((r for r in sizes if r["word"] == word), key=lambda r: -r["class"]):
            room -= r["n"]
            if room < 0:
                break
            least[word] = r["class"]
    words = counted.where(f"b IS NULL AND class >= {least[True]}").select("a").collect()
    pairs = counted.where(f"b IS NOT NULL AND class >= {least[False]}").select("a", "b").collect()
    return Head.of(sorted(r["a"] for r in words), sorted((r["a"], r["b"]) for r in pairs))


# ---- features --------------------------------------------------------------------------
class Featurizer:
    """Buckets of all features of the words of a step."""

    def __init__(self, head: Head):
        self.head, self.shift = head, shifter()
        self.bits = max(4, int(4 * len(head.pairs) + 1).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)   # pairs by hash, and where they are
        self.place = np.zeros(1 << self.bits, np.int64)
        for at, (key, slot) in enumerate(zip(head.pairs.tolist(), self._slot(head.pairs).tolist(), strict=True)):
            if self.slots[slot] == -1:  # of two pairs in one slot the second goes the tail's way
                self.slots[slot], self.place[slot] = key, at
        self.bucket = (head.states % np.uint32(BUCKETS)).astype(np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def buckets(self, w: Numbered, carried: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(text, bucket) of every feature; runs that end in the first ``carried`` words of a text
        are left out (of a piece with carried words there is only one text)."""
        head, n = self.head, len(w.codes)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = pc.index_in(w.dictionary, head.words).fill_null(-1).to_numpy(zero_copy_only=False)
        rare = np.flatnonzero(known < 0)
        size = len(w.dictionary)
        alone, spaced = np.zeros(size, np.uint32), np.zeros(size, np.uint32)
        length = np.zeros(size, np.int64)
        held = known >= 0
        alone[held], spaced[held] = head.alone[known[held]], head.spaced[known[held]]
        length[held] = head.length[known[held]]
        raw = w.dictionary.take(pa.array(rare)).cast(pa.large_binary()).to_pylist()
        alone[rare], spaced[rare] = crcs(raw), crcs([b" " + x for x in raw])
        length[rare] = [len(x) for x in raw]

        one, after, over = alone[w.codes], spaced[w.codes], length[w.codes] + 1
        single = (one % np.uint32(BUCKETS)).astype(np.int64)
        near = np.flatnonzero(w.text[1:] == w.text[:-1])  # starts of pairs
        number = known[w.codes].astype(np.int64)
        a, b = number[near], number[near + 1]
        key = np.where((a >= 0) & (b >= 0), a * max(1, len(head.words)) + b, -2)
        slot = self._slot(key)
        hit = self.slots[slot] == key
        state, double = np.empty(len(near), np.uint32), np.empty(len(near), np.int64)
        place = self.place[slot[hit]]
        state[hit], double[hit] = head.states[place], self.bucket[place]
        other = near[~hit]
        state[~hit] = self.shift(one[other], over[other + 1]) ^ after[other + 1]
        double[~hit] = state[~hit] % np.uint32(BUCKETS)
        three = np.flatnonzero(np.diff(near) == 1)  # pairs followed by one that starts a word later
        third = near[three] + 2
        triple = ((self.shift(state[three], over[third]) ^ after[third]) % np.uint32(BUCKETS)).astype(np.int64)
        at = np.arange(n)
        text = np.concatenate([w.text[at >= carried], w.text[near[near + 1 >= carried]],
                               w.text[third[third >= carried]]])
        return text, np.concatenate([single[at >= carried], double[near + 1 >= carried],
                                     triple[third >= carried]])


def bucket_totals(texts: DataFrame, head: Head) -> np.ndarray:
    """Features of all rows in each bucket; ``texts`` has a column ``text``."""
    sent = texts.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Featurizer(sent.value), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for p in pieces(batch.column(0), ALNUM, carry=2):
                total += np.bincount(features.buckets(numbered(p.texts), p.carried)[1], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["b", "n"])
        give_back_memory()

    out = np.zeros(BUCKETS, np.int64)
    counted = texts.select(F.col("text").cast("string").alias("t")).mapInArrow(run, "b long, n long")
    for b, n in counted.groupBy("b").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        out[b] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    s_all, t_all = int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + BUCKETS) / ((s + 1) * (t_all + BUCKETS))))
                     for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, head: Head, gain: np.ndarray) -> DataFrame:
    """Per row: doc_id, n_words, n_features, weight."""
    sent = docs.sparkSession.sparkContext.broadcast((head, gain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, gain = sent.value
        features, gain = Featurizer(head), gain.astype(float)  # sums stay whole below 2**53
        for batch in batches:
            rows = batch.num_rows
            words, n, weight = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            for p in pieces(batch.column(1), ALNUM, carry=2):
                w = numbered(p.texts)
                text, bucket = features.buckets(w, p.carried)
                here, size = slice(p.first, p.first + len(p.texts)), len(p.texts)
                words[here] += np.bincount(w.text, minlength=size) - p.carried
                n[here] += np.bincount(text, minlength=size)
                weight[here] += np.bincount(text, gain[bucket], size).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words), pa.array(n), pa.array(weight)],
                ["doc_id", "n_words", "n_features", "weight"])
        give_back_memory()

    read = docs.select(F.col("doc_id").cast("long").alias("i"), F.col("text").cast("string").alias("t"))
    return read.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


# ---- draw -------------------------------------------------------------------------------
def noise(doc_id: str = "doc_id", seed: int = SEED):
    """Gumbel noise in thousandths, fixed by seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, eligible, percent: int = DRAWN_PERCENT) -> DataFrame:
    """``rows`` (doc_id, score, ...) with ``rank``: 1, 2, ... for the ``percent`` of the eligible
    rows with the highest scores, null for all others. No task sorts more than its range."""
    spark = rows.sparkSession
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    marked = checkpointed(rows.withColumn("__in", F.coalesce(eligible, F.lit(False)))
                          .withColumn("__tie", F.monotonically_increasing_id()))  # parts equal rows
    placed = checkpointed(
        marked.where("__in").repartitionByRange(*order, F.col("__tie")).sortWithinPartitions(*order, "__tie")
        .withColumn("__at", F.monotonically_increasing_id()))
    ranges = placed.groupBy(F.shiftright("__at", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    base, before = [], 0
    for r in sorted(ranges, key=lambda r: r["p"]):  # a row for each range
        base.append((r["p"], before))
        before += r["n"]
    drawn = before * percent // 100
    bases = spark.createDataFrame(base, "p long, base long")
    rank = F.col("base") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    names = rows.columns
    got = (placed.withColumn("p", F.shiftright("__at", 33)).join(F.broadcast(bases), "p")
           .select(*names, F.when(rank <= drawn, rank).alias("rank")))
    return got.unionByName(marked.where("NOT __in").select(*names, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = DRAWN_PERCENT) -> DataFrame:
    """Per document: doc_id, n_features, weight, score, rank (null where not drawn)."""
    head = frequent(docs)
    gain = gains(bucket_totals(docs, head), bucket_totals(target, head))
    scored = weighed(docs, head, gain).withColumn("score", F.col("weight") + noise())
    return ranked(scored, F.col("n_words") >= MIN_WORDS, percent).select(
        "doc_id", "n_features", "weight", "score", "rank")


def drawn_documents(docs: DataFrame, target: DataFrame, percent: int = DRAWN_PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, whose id is drawn."""
    ids = (resample(docs, target, percent).where("rank IS NOT NULL").select(F.col("doc_id").alias("i__"))
           .distinct())
    return docs.join(ids, F.col("doc_id").cast("long").eqNullSafe(ids["i__"]), "left_semi")
