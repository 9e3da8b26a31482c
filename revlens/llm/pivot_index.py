"""Exact top-k search by inner product with a pivot-distance index.

Every vector belongs to its nearest pivot and is keyed by the distance to it; the sorted
distances of a pivot are cut into rings (annuli), large rings into blocks of ``BLOCK`` vectors.
For a query q at distance d from pivot p, the triangle inequality gives every vector v of a
ring [lo, hi] of p a distance to q of at least the gap between d and [lo, hi], so

    <q, v> = (|q|^2 + |v|^2 - |q - v|^2) / 2 <= (|q|^2 + max |v|^2 - gap^2) / 2

(and at most |q| max |v|). A first pass searches the ring each query lies in and leaves a
threshold, its k-th best score; the second expands the sorted rings while their bound reaches
the threshold and skips the rest. Skipped rings can't hold a better row, so results are exact.

Only pivots (of a bounded sample) and the rings' bounds, ``PIVOTS * RINGS`` rows whatever
the input, are sent to all tasks. Queries travel in blocks and meet blocks of vectors; equal
vectors are kept once with their k + 1 smallest ids, so a vector that a third of all rows
repeat is one entry.

Components are floor(256 x) as 64-bit integers; scores are exact integers while their
products stay below 2**63. Cases: null vectors and vectors with a null or non-finite component
take no part, neither as query nor as candidate; null ids take no part; vectors of another
length than the query's are no candidates; repeated rows of one id count once; ties go to the
smaller id; fewer candidates than k give fewer rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm.common import checkpointed

PIVOTS = 16
RINGS = 8
SAMPLE = 2_000    # vectors that pivots are chosen from
BLOCK = 4_096     # vectors in a block
QUERY_BLOCK = 512


def quantised(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(i, v): ids and integer vectors of the rows that take part."""
    x = F.transform(vec_col, lambda c: c.cast("double"))
    good = ~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (rows.select(F.col(id_col).cast("long").alias("i"), x.alias("x"))
            .where(F.col("i").isNotNull() & F.col("x").isNotNull()).where(good)
            .select("i", F.transform("x", lambda c: F.floor(c * 256)).alias("v")))


def packed(rows: DataFrame, keep: int) -> DataFrame:
    """(i, dim, v as bytes): of equal vectors in a task the ``keep`` smallest ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            v = [np.asarray(x, "<i8") for x in batch["v"]]
            out = pd.DataFrame({"i": batch["i"], "dim": [len(x) for x in v],
                                "v": [x.tobytes() for x in v]}).drop_duplicates()
            yield out.sort_values("i").groupby("v", sort=False).head(keep)

    return rows.mapInPandas(run, "i long, dim int, v binary")


def matrix(blobs, dim: int) -> np.ndarray:
    if not dim:
        return np.zeros((sum(1 for _ in blobs), 0), np.int64)
    return np.frombuffer(b"".join(blobs), "<i8").reshape(-1, dim)


def farthest_first(sample: np.ndarray, k: int) -> np.ndarray:
    """Pivots: the sample's first row, then always the row farthest from those chosen."""
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(k, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x ** 2).sum(1)[:, None] + (pivots ** 2).sum(1)[None, :] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0.0))


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products: by floating point where that is exact, else by integers."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, q.shape[1])
    if top < 2 ** 53:
        return (q.astype(float) @ v.astype(float).T).astype(np.int64)
    return q @ v.T


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of each row the columns of the k best scores, ties to the smaller id."""
    for r, s in enumerate(scores):
        at = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k]) if len(s) > k \
            else np.arange(len(s))
        yield r, at[np.lexsort((ids[at], -s[at]))][:k]


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id",
          vec_col: str = "embedding") -> DataFrame:
    """Per query: query_id, rank (from 1), vec_id, score; each query's own id is no candidate.

    ``queries`` has the same columns as ``rows``.
    """
    spark = rows.sparkSession
    out_schema = "query_id long, vec_id long, score long"
    keep = k + 1
    by_vector = Window.partitionBy("dim", "v").orderBy("i")  # k + 1 rows a task at most
    vectors = checkpointed(
        packed(quantised(rows, id_col, vec_col), keep).distinct()
        .withColumn("r", F.row_number().over(by_vector)).where(F.col("r") <= keep)
        .groupBy("dim", "v").agg(F.sort_array(F.collect_list("i")).alias("ids")))
    asked = checkpointed(quantised(queries, id_col, vec_col)
                         .select("i", F.size("v").alias("dim"), "v").dropDuplicates(["i"]))
    parts = []
    for dim in [r["dim"] for r in asked.select("dim").distinct().limit(1_000).collect()]:
        parts.append(_search(spark, vectors.where(F.col("dim") == dim).select("v", "ids"),
                             asked.where(F.col("dim") == dim).select("i", "v"), dim, k))
    if not parts:
        found = spark.createDataFrame([], out_schema)
    else:
        found = parts[0]
        for p in parts[1:]:
            found = found.union(p)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _search(spark, vectors: DataFrame, asked: DataFrame, dim: int, k: int) -> DataFrame:
    sample = vectors.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).collect()
    pivots = farthest_first(matrix([r["v"] for r in sample], dim).astype(float), PIVOTS) \
        if sample else np.zeros((1, dim))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = matrix(batch["v"], dim).astype(float)
            d = distances(x, pivots)
            cell = d.argmin(1)
            yield batch.assign(cell=cell, dist=d[np.arange(len(x)), cell], norm=np.sqrt((x ** 2).sum(1)))

    placed = checkpointed(vectors.mapInPandas(
        place, "v binary, ids array<long>, cell int, dist double, norm double"))
    cuts = {r["cell"]: r["c"] for r in placed.groupBy("cell").agg(  # at most PIVOTS rows
        F.percentile_approx("dist", [n / RINGS for n in range(1, RINGS)], 10_000).alias("c")).collect()}

    def ring(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            number = [c * RINGS + int(np.searchsorted(cuts[c], d)) for c, d in
                      zip(batch["cell"], batch["dist"], strict=True)]
            yield batch.assign(ring=number)

    ringed = placed.mapInPandas(
        ring, "v binary, ids array<long>, cell int, dist double, norm double, ring int")
    rings = ringed.groupBy("ring", "cell").agg(
        F.min("dist").alias("lo"), F.max("dist").alias("hi"), F.max("norm").alias("norm"),
        F.count(F.lit(1)).alias("n")).orderBy("ring").collect()  # PIVOTS * RINGS rows at most
    if not rings:
        return spark.createDataFrame([], "query_id long, vec_id long, score long")
    lo, hi, norm = (np.array([r[c] for r in rings]) for c in ("lo", "hi", "norm"))
    cell, number = np.array([r["cell"] for r in rings]), np.array([r["ring"] for r in rings])
    blocks_of = {r["ring"]: -(-r["n"] // BLOCK) for r in rings}

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Dealt by content, so that a rerun deals alike."""
        import xxhash

        for batch in batches:
            yield batch.assign(block=[xxhash.xxh32_intdigest(v) % blocks_of[r] for v, r in
                                      zip(batch["v"], batch["ring"], strict=True)])[
                ["ring", "block", "v", "ids"]]

    blocks = checkpointed(
        ringed.mapInPandas(block, "ring int, block int, v binary, ids array<long>")
        .groupBy("ring", "block").agg(F.collect_list(F.struct("v", "ids")).alias("rows")))

    def bounds(q: np.ndarray) -> np.ndarray:
        d = distances(q, pivots)[:, cell]
        gap = np.maximum(np.maximum(lo - d, d - hi), 0.0)
        length = np.sqrt((q ** 2).sum(1))[:, None]
        bound = np.minimum((length ** 2 + norm ** 2 - gap ** 2) / 2, length * norm)
        return bound + 1e-6 * (1.0 + length * norm)  # the distances are rounded

    def ask(own: bool):
        """Blocks of queries to each block of the rings they need."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), QUERY_BLOCK):
                    b = batch.iloc[at:at + QUERY_BLOCK]
                    q = np.array(b["v"].tolist(), np.int64).reshape(len(b), dim)
                    bound = bounds(q.astype(float))
                    nearest = bound.argmax(1)
                    if own:
                        needs = np.zeros(bound.shape, bool)
                        needs[np.arange(len(b)), nearest] = True
                    else:
                        needs = bound >= b["least"].to_numpy()[:, None]
                    for r in np.flatnonzero(needs.any(0)):
                        who = needs[:, r]
                        ids = b["i"].to_numpy()[who].astype("<i8").tobytes()
                        for n in range(blocks_of[number[r]]):
                            yield pd.DataFrame({"ring": [number[r]], "block": [n], "who": [ids],
                                                "q": [q[who].astype("<i8").tobytes()]})

        return run

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for who, q, found in zip(batch["who"], batch["q"], batch["rows"], strict=True):
                v = matrix([r["v"] for r in found], dim)
                ids = [r["ids"] for r in found]
                first = np.array([x[0] for x in ids])
                names = np.frombuffer(who, "<i8")
                s = products(matrix([q], dim) if dim else np.zeros((len(names), 0), np.int64), v)
                out = []
                for r, at in best(s, first, k + 1):
                    hits = sorted((-int(s[r, j]), int(i)) for j in at for i in ids[j] if i != names[r])
                    out += [(int(names[r]), i, -x) for x, i in hits[:k]]
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    def searched(queries: DataFrame, own: bool) -> DataFrame:
        pairs = queries.mapInPandas(ask(own), "ring int, block int, who binary, q binary")
        return (pairs.join(blocks, ["ring", "block"]).select("who", "q", "rows")
                .mapInPandas(search, "query_id long, vec_id long, score long"))

    first = checkpointed(searched(asked, True))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    least = (first.withColumn("r", F.row_number().over(order)).where(F.col("r") == k)
             .select(F.col("query_id").alias("i"), F.col("score").cast("double").alias("least")))
    known = asked.join(least, "i", "left").fillna({"least": float("-inf")})
    return searched(known, False).union(first).distinct()
