"""N-gram Jaccard join: documents whose sets of word n-grams are alike, as components.

Two documents link when 100 * |intersection| >= 80 * |union| of their sets of distinct 5-word
shingles (a text of fewer words is one shingle; a text without words has none and links with
nothing). The result has each document's set size and the smallest id reachable by links.

Plan, each step over all documents:

1. *Classes.* Documents with equal sets are one class (signature: two 64-bit sums over the
   set), represented by the smallest id. Copies never meet in a join.
2. *Frequencies.* Every class sends its hashes to the bucket of their hash range, as packed,
   delta-coded runs (not a row per n-gram). The bucket counts the classes of each hash; only
   hashes of two classes or more go back. A hash that many documents of one run share is sent
   once with its count (pre-aggregation), so a passage in a third of all documents is one entry
   a run. Buckets are as many as keep ``BUCKET_ENTRIES`` each; a run holds ``RUN_ENTRIES``.
3. *Prefixes.* A set of n n-grams, ordered rarest first, can only reach the threshold with a
   partner through its first n - ceil(0.8 n) + 1 n-grams. Hashes of one class come first and
   have no partner, so a class whose prefix has no other hash is done here: most are.
4. *Join* on prefix n-grams, with the length filter, the positional filter and a suffix filter
   (shared n-grams bounded by the counts in ranges of the hash), each pair verified once.
   All pairs of a large group of near copies would grow with its square, and only components
   are asked for: first each n-gram's most central class (fewest n-grams of its own) is
   compared with the others that share it; then every pair that still lies in two different
   components is compared. A pair inside one component can't change the result. So the
   components are exact, without a cap.
5. *Components* by alternating large-star and small-star steps over the links.

Cases: null text has an empty set; null ids can't be named by others, don't link, and get a
null component; rows with the same id count as one document each but share the id; ties
between centres go to the smaller id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import checkpointed, give_back_memory
from revlens.llm.digest import powers

SHINGLE = 5
PERCENT = 80
PIECE_BYTES = 1_000_000      # texts are hashed in pieces of about this size
RUN_ENTRIES = 1_000_000      # hashes of the texts that are sent as one run, about
BUCKET_ENTRIES = 1_000_000   # hashes a bucket, about
SHARED_LEAST = 8             # documents of a run that share a hash, to be sent as a count
SHARED_PART = 64             # and at least this part of the run's documents
RANGES = 32                  # of the suffix filter
HASH_BITS = 56               # sent of each hash; the sets' sizes and signatures use all 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def need(n: int) -> int:
    """Fewest n-grams that a set of n shares with any partner: ceil(0.8 n)."""
    return -(-PERCENT * n // 100)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


# ---- sets of hashes -------------------------------------------------------------------------
def shingle_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts and the text each is from, in the texts' order."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.int32)
    x = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    space = _SPACE[x]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return none
    power, inverse = powers(len(x))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((x + np.uint64(1)) * power[:len(x)])])
    word = mixed((total[end] - total[begin]) * inverse[begin])
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    doc = (np.searchsorted(first, begin, "right") - 1).astype(np.int32)
    count = np.bincount(doc, minlength=len(texts))
    at = np.concatenate([[0], np.cumsum(count)])
    hashes, owners = [], []
    n = len(word) - SHINGLE + 1
    if n > 0:
        h = word[:n] * _ODD[0]
        for k in range(1, SHINGLE):
            h += word[k:n + k] * _ODD[k]
        full = doc[:n] == doc[SHINGLE - 1:]
        hashes.append(mixed(h[full]))
        owners.append(doc[:n][full])
    for size in range(1, SHINGLE):
        few = np.flatnonzero(count == size)
        if len(few):
            h = np.full(len(few), size, np.uint64) * _ODD[-1]
            for k in range(size):
                h += word[at[few] + k] * _ODD[k]
            hashes.append(mixed(h))
            owners.append(few.astype(np.int32))
    h, owner = np.concatenate(hashes), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return h[order], owner[order]


def distinct_sorted(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (hash, text), ordered by hash, then text."""
    order = np.argsort(h)
    h, owner = h[order], owner[order]
    same = h[1:] == h[:-1]
    tied = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
    if len(tied):
        sub = tied[np.lexsort((owner[tied], h[tied]))]
        owner[tied] = owner[sub]
    keep = np.ones(len(h), bool)
    keep[1:] = ~(same & (owner[1:] == owner[:-1]))
    return h[keep], owner[keep]


class Piece:
    """The sets of some texts: hash and owner ordered by hash; n and signatures by text."""

    def __init__(self, texts: list[bytes]):
        h, owner = shingle_hashes(texts)
        self.h, self.owner = distinct_sorted(h, owner)
        k = len(texts)
        self.n = np.bincount(self.owner, minlength=k)
        by = np.argsort(self.owner, kind="stable")
        start = np.concatenate([[0], np.cumsum(self.n)])[:-1]
        self.sig = np.zeros((2, k), np.uint64)
        some = self.n > 0
        if some.any():
            for i, odd in enumerate(_ODD[:2]):
                self.sig[i, some] = np.add.reduceat(mixed(self.h[by] * odd), start[some])


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Piece]]:
    """Column ``t`` holds the texts as bytes."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("t")), 0).to_numpy()
        ends = np.searchsorted(np.cumsum(sizes), np.arange(1, sizes.sum() // PIECE_BYTES + 1) * PIECE_BYTES)
        cuts = np.unique(np.concatenate([[0], ends + 1, [batch.num_rows]]).clip(0, batch.num_rows))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            part = batch.slice(lo, hi - lo)
            yield part, Piece([t or b"" for t in part.column("t").to_pylist()])
    give_back_memory()


def class_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, piece in pieces(batches):
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(piece.n.astype(np.int32)),
             pa.array(piece.sig[0].view(np.int64)), pa.array(piece.sig[1].view(np.int64))],
            ["doc_id", "n", "s1", "s2"])


# ---- packed runs of hashes --------------------------------------------------------------------
def packed(h: np.ndarray) -> tuple[int, int, bytes]:
    """Ascending hashes as the first and the differences, in as many bytes as the largest needs."""
    first = int(h[0]) if len(h) else 0
    gap = np.diff(h, prepend=np.uint64(first))
    k = max(1, (int(gap.max()).bit_length() + 7) // 8) if len(gap) else 1
    return first, k, np.ascontiguousarray(gap.view(np.uint8).reshape(-1, 8)[:, :k]).tobytes()


def unpacked(first: int, k: int, body: bytes) -> np.ndarray:
    raw = np.frombuffer(body, np.uint8).reshape(-1, k)
    gap = np.zeros((len(raw), 8), np.uint8)
    gap[:, :k] = raw
    return np.cumsum(gap.reshape(-1).view(np.uint64), dtype=np.uint64) + np.uint64(first)


def small(a: np.ndarray) -> np.ndarray:
    return a.astype(np.min_scalar_type(int(a.max())) if len(a) else np.uint8)


def fresh_runs(batches: Iterator[pa.RecordBatch]
               ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of the task's classes, each once: hashes and owners by hash, signatures, sizes."""
    seen: set[bytes] = set()
    hs, owners, sigs, ns = [], [], [], []
    docs = held = 0

    def run():
        h, owner = np.concatenate(hs), np.concatenate(owners)
        order = np.argsort(h, kind="stable")
        return h[order], owner[order], np.concatenate(sigs, axis=1), np.concatenate(ns)

    for _, piece in pieces(batches):
        fresh = np.zeros(len(piece.n), bool)
        for i, key in enumerate(map(bytes, piece.sig.T.copy())):
            if piece.n[i] and key not in seen:
                seen.add(key)
                fresh[i] = True
        keep = fresh[piece.owner]
        hs.append(piece.h[keep] >> np.uint64(64 - HASH_BITS))
        owners.append((np.cumsum(fresh) - 1 + docs)[piece.owner[keep]])
        sigs.append(piece.sig[:, fresh])
        ns.append(piece.n[fresh])
        docs += int(fresh.sum())
        held += len(hs[-1])
        if held >= RUN_ENTRIES:
            yield run()
            hs, owners, sigs, ns = [], [], [], []
            docs = held = 0
    if docs:
        yield run()


def postings(buckets: int):
    """Each run's hashes to their buckets; the run's classes ride along with one of them."""

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        edges = np.array([-(-(b << 32) // buckets) for b in range(1, buckets)], np.uint64)
        for number, (h, ref, sig, n) in enumerate(fresh_runs(batches)):
            docs = len(n)
            # hashes that many of the run's documents share: one entry with its count
            lead = np.concatenate([[True], h[1:] != h[:-1]])
            place = np.cumsum(lead) - 1
            many = np.bincount(place)
            shared = many >= max(SHARED_LEAST, docs / SHARED_PART)
            held, weight = [], many[shared]
            if shared.any():
                inside = shared[place]
                which = (np.cumsum(shared) - 1)[place[inside]]
                held = np.split(ref[inside], np.searchsorted(which, np.arange(1, len(weight))))
                held = [small(x) for x in held]
                ref = np.where(inside, docs + (np.cumsum(shared) - 1)[place], ref)
                once = ~inside | lead
                h, ref = h[once], ref[once]
            run_id = part * 100_000 + number
            cut = np.searchsorted(h >> np.uint64(HASH_BITS - 32), edges)
            blobs, names = [], []
            for b, (x, y) in enumerate(zip([0, *cut], [*cut, len(h)], strict=True)):
                if x < y:
                    blobs.append(pickle.dumps((packed(h[x:y]), small(ref[x:y]), sig[0], weight)))
                    names.append(b)
            blobs.append(pickle.dumps((sig, n, held)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([*names, run_id % buckets], pa.int32()),
                 pa.array([run_id] * len(blobs), pa.int64()),
                 pa.array([0] * len(names) + [1], pa.int32()), pa.array(blobs, pa.binary())],
                ["bucket", "run", "kind", "body"])

    return run_all


def count_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    out = _counted(rows)
    give_back_memory()
    return out


def _counted(rows: pd.DataFrame) -> pd.DataFrame:
    """The bucket's hashes that two classes or more have, back to each run, with their number."""
    own = rows[rows["kind"] == 0]
    told = [rows[rows["kind"] == 1][["run", "kind", "body"]]]
    hs, refs, runs_, classes, weights = [], [], [], [], []
    for k, body in enumerate(own["body"]):
        body, ref, sig, weight = pickle.loads(body)
        ref = ref.astype(np.int64)
        hs.append(unpacked(*body))
        refs.append(ref)
        runs_.append(np.full(len(ref), k, np.int32))
        docs = len(sig)
        alone = ref < docs
        classes.append(np.where(alone, sig[np.minimum(ref, docs - 1)],
                                mixed((ref + (k << 32)).astype(np.uint64))))
        weights.append(np.where(alone, 1, np.append(weight, 1)[np.maximum(ref - docs, 0)]
                                if len(weight) else 1))
    if hs:
        h = np.concatenate(hs)
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        few = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        weight = np.concatenate(weights)
        sub = order[few | (weight[order] > 1)]
        h, cls, weight = h[sub], np.concatenate(classes)[sub], weight[sub]
        ref, run = np.concatenate(refs)[sub], np.concatenate(runs_)[sub]
        order = np.lexsort((cls, h))
        h, cls, weight, ref, run = h[order], cls[order], weight[order], ref[order], run[order]
        if len(h):
            lead = np.concatenate([[True], h[1:] != h[:-1]])
            new = lead | np.concatenate([[True], cls[1:] != cls[:-1]])
            place = np.cumsum(lead) - 1
            df = np.bincount(place, np.where(new, weight, 0)).astype(np.int64)[place]
            order = np.flatnonzero(df > 1)
            order = order[np.argsort(run[order], kind="stable")]
            cut = np.searchsorted(run[order], np.arange(len(own) + 1))
            names = own["run"].to_numpy()
            out = [(names[k], pickle.dumps((packed(h[o]), small(ref[o]), small(df[o]))))
                   for k in range(len(own)) if len(o := order[cut[k]:cut[k + 1]])]
            told.append(pd.DataFrame({"run": [a for a, _ in out], "kind": 0,
                                      "body": [b for _, b in out]}))
    return pd.concat(told)


def prefixes(rows: pd.DataFrame) -> pd.DataFrame:
    """The run's classes that may have a partner, with their shared hashes, rarest first."""
    empty = pd.DataFrame({"s1": [], "s2": [], "n": [], "own": [], "prefix": [], "shared": []})
    about = rows[rows["kind"] == 1]["body"]
    rest = rows[rows["kind"] == 0]["body"]
    if not len(rest):
        return empty
    sig, n, held = pickle.loads(about.iloc[0])
    docs = len(n)
    hs, ds, fs = [], [], []
    for body in rest:
        body, ref, df = pickle.loads(body)
        h, ref, df = unpacked(*body), ref.astype(np.int64), df.astype(np.int64)
        alone = ref < docs
        hs.append(h[alone])
        ds.append(ref[alone])
        fs.append(df[alone])
        for k in np.flatnonzero(~alone):
            who = held[ref[k] - docs].astype(np.int64)
            hs.append(np.full(len(who), h[k], np.uint64))
            ds.append(who)
            fs.append(np.full(len(who), df[k]))
    h, doc, df = np.concatenate(hs), np.concatenate(ds), np.concatenate(fs)
    some = np.bincount(doc, minlength=docs)
    least = -(-PERCENT * n // 100)
    alive = (some >= least) & (n > 0)
    keep = alive[doc]
    h, doc, df = h[keep], doc[keep], df[keep]
    order = np.lexsort((h, df, doc))
    h, doc = h[order], doc[order]
    cut = np.searchsorted(doc, np.arange(docs + 1))
    who = np.flatnonzero(alive)
    if not len(who):
        return empty
    own = n[who] - some[who]
    return pd.DataFrame({
        "s1": sig[0, who].view(np.int64), "s2": sig[1, who].view(np.int64), "n": n[who], "own": own,
        "prefix": n[who] - least[who] + 1 - own,
        "shared": [h[cut[i]:cut[i + 1]].tobytes() for i in who]})


# ---- candidates and links -----------------------------------------------------------------------
def prefix_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each prefix n-gram; ``counts`` are the shared hashes' numbers by hash range."""
    for batch in batches:
        for lo in range(0, len(batch), 500):
            b = batch.iloc[lo:lo + 500]
            sets = [np.frombuffer(x, np.uint64) for x in b["shared"]]
            sizes = b["prefix"].to_numpy()
            counts = [np.minimum(np.bincount((s >> np.uint64(HASH_BITS - 5)).astype(np.int64), minlength=RANGES),
                                 65535).astype("<u2").tobytes() for s in sets]
            yield pd.DataFrame({
                "gram": np.concatenate([s[:k] for s, k in zip(sets, sizes, strict=True)]).view(np.int64),
                "c": np.repeat(b["c"].to_numpy(), sizes), "n": np.repeat(b["n"].to_numpy(), sizes),
                "own": np.repeat(b["own"].to_numpy(), sizes),
                "at": np.concatenate([o + np.arange(k) for o, k in
                                      zip(b["own"].to_numpy(), sizes, strict=True)]),
                "counts": np.repeat(np.array(counts, object), sizes)})


def suffix_filter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            a = np.frombuffer(b"".join(batch["counts_a"]), "<u2").reshape(-1, RANGES).astype(np.int64)
            b = np.frombuffer(b"".join(batch["counts_b"]), "<u2").reshape(-1, RANGES).astype(np.int64)
            most = np.where(((a == 65535) | (b == 65535)).any(axis=1), np.iinfo(np.int64).max,
                            np.minimum(a, b).sum(axis=1))
            batch = batch[most >= batch["need"].to_numpy()]
        yield batch[["a", "b"]]


def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ok = []
        for n, m, x, y in zip(batch["n_a"], batch["n_b"], batch["shared_a"], batch["shared_b"],
                              strict=True):
            common = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64),
                                        assume_unique=True))
            ok.append(100 * common >= PERCENT * (n + m - common))
        yield batch.loc[ok, ["a", "b"]]


def _filtered(joined: DataFrame) -> DataFrame:
    """Candidate pairs (a < b) of rows a_*, b_* that share a prefix n-gram, once each."""
    na, nb, ia, ib = (F.col(x) for x in ("n_a", "n_b", "at_a", "at_b"))
    least = F.ceil(F.lit(PERCENT) * (na + nb) / F.lit(100 + PERCENT)).cast("int")
    pairs = (joined.withColumn("need", least)
             .where(F.least(na, nb) * 100 >= F.greatest(na, nb) * PERCENT)            # length
             .where(1 + F.least(na - ia, nb - ib) - 1 >= F.col("need"))               # position
             .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "need",
                     "counts_a", "counts_b"))
    return pairs.mapInPandas(suffix_filter, "a long, b long").distinct()


def _side(rows: DataFrame, s: str) -> DataFrame:
    return rows.select("gram", F.col("c").alias(s), *(
        F.col(x).alias(f"{x}_{s}") for x in ("n", "at", "counts", "own", "comp")))


def central_pairs(rows: DataFrame) -> DataFrame:
    """Every n-gram's classes with the most central one among them."""
    a = _side(rows, "a")
    lead = (rows.groupBy("gram").agg(
        F.min(F.struct((F.col("own") / F.col("n")).alias("x"), "c", "n", "at", "counts", "own", "comp"))
        .alias("l"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        .where("lo <> hi").select("gram", "l.*"))
    return _filtered(a.join(_side(lead, "b"), "gram").where("comp_a <> comp_b"))


def crossing_pairs(rows: DataFrame) -> DataFrame:
    """All pairs that share an n-gram and lie in different components.

    Members of an n-gram's largest component meet the others only, never each other.
    """
    largest = (rows.groupBy("gram", "comp").count().groupBy("gram")
               .agg(F.max_by("comp", F.struct("count", "comp")).alias("most"),
                    F.count(F.lit(1)).alias("k")).where("k > 1").drop("k"))
    mixed_rows = rows.join(largest, "gram")
    a = _side(mixed_rows.where("comp <> most"), "a")
    b = _side(mixed_rows, "b").join(largest, "gram")
    return _filtered(a.join(b, "gram").where("comp_a <> comp_b AND (comp_b = most OR a < b)"))


def linked(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    sets = classes.select("c", "n", "shared")
    for s in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("c").alias(s), F.col("n").alias(f"n_{s}"),
                                       F.col("shared").alias(f"shared_{s}")), s)
    return pairs.mapInPandas(verify, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(c, comp): the smallest node reachable, for every node that has a link (a, b)."""
    edges = checkpointed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                         .where("u <> v").distinct())
    state = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small_ = large.join(least, "u")
        edges = checkpointed(small_.select(F.col("v").alias("u"), F.col("m").alias("v"))
                             .union(least.select("u", F.col("m").alias("v")))
                             .where("u <> v").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("c"), F.col("v").alias("comp")).union(
                edges.select(F.col("v").alias("c"), F.col("v").alias("comp")).distinct())
        state = now


def _with_components(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("comp", F.col("c"))
    return (rows.join(labels, "c", "left")
            .withColumn("comp", F.coalesce("comp", "c")))


def ngram_components(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, class_id (smallest id with an equal set)."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").cast("binary").alias("t"))
    members = checkpointed(read.mapInArrow(class_rows, "doc_id long, n int, s1 long, s2 long"))
    reps = (members.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "s1", "s2")
            .agg(F.min("doc_id").alias("c")))
    entries = members.agg(F.sum("n")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries // BUCKET_ENTRIES))
    counted = (read.where(F.col("doc_id").isNotNull()).select("t")
               .mapInArrow(postings(buckets), "bucket int, run long, kind int, body binary")
               .groupBy("bucket").applyInPandas(count_bucket, "run long, kind int, body binary"))
    alive = counted.groupBy("run").applyInPandas(
        prefixes, "s1 long, s2 long, n int, own int, prefix int, shared binary")
    classes = checkpointed(alive.dropDuplicates(["n", "s1", "s2"]).join(reps, ["n", "s1", "s2"])
                           .select("c", "n", "own", "prefix", "shared"))
    rows = classes.mapInPandas(
        prefix_rows, "gram long, c long, n int, own int, at int, counts binary")
    first = checkpointed(central_pairs(_with_components(rows, None)))
    links = checkpointed(linked(first, classes))
    labels = components(links)
    rest = crossing_pairs(_with_components(rows, labels)).join(first, ["a", "b"], "left_anti")
    links = links.union(checkpointed(linked(rest, classes)))
    labels = components(links)
    named = reps.join(labels, "c", "left").select(
        "n", "s1", "s2", "c", F.coalesce("comp", "c").alias("comp"))
    return (members.join(named, ["n", "s1", "s2"], "left")
            .select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("n").cast("long").alias("n_shingles"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id")).cast(kind)
                    .alias("component_id"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id")).cast(kind)
                    .alias("class_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: of each component the smallest id.

    Rows with a null id stay; of rows with the same id one stays.
    """
    found = ngram_components(docs).where("doc_id IS NOT NULL")
    gone = checkpointed(found.groupBy("doc_id").agg(
        F.max((F.col("component_id") != F.col("doc_id")).cast("int")).alias("g"),
        F.count(F.lit(1)).alias("k")))
    out = docs.join(gone.where("g = 1").select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    if not gone.where("g = 0 AND k > 1").isEmpty():
        out = out.where("doc_id IS NULL").union(
            out.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]))
    return out
