"""Document fingerprints from improbable features.

Every window of ``WINDOW`` bytes is ranked by how improbable its byte entropy is (distance
from the entropy that running text usually has). Among each ``WINDOW`` neighbouring windows
the most improbable one gets a vote, and windows with ``MIN_VOTES`` become features: a choice
that depends on the nearby bytes only, so an edit changes the features around it and no
others. Distinct features enter, in the order of the text, a chain of Bloom filters of
``FILTER_BITS`` bits, ``FILTER_FEATURES`` features each. Two fingerprints are compared by
the bits their filters share, normalised between chance (0) and the most possible (1): each
filter of the shorter chain takes its best partner, weighted by its bits.

All windows of many texts are handled by a few array operations: the entropy of the next
window follows from the counts of the byte that leaves and the byte that enters.

``fingerprint_documents`` also fingerprints an edited text made from the document and the next
one by ascending id. Documents are dealt by ranges of the id; the first document of a range is
sent to the range before it too, so no task needs more than its own rows.

Cases: null text counts as empty; an empty text has no filters, and is like (1.0) other
empty texts only; a text shorter than a window is one feature; null ids come first; rows with
equal ids follow each other by text; a single document is its own next one; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 64
MIN_VOTES = 16
FILTER_BITS = 2048
FILTER_FEATURES = 160
FEATURE_BITS = 5
USUAL_ENTROPY = 4.0        # bits a byte, of a window of running text
STEP_BYTES = 100_000       # texts are handled in runs of about this many bytes
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64

_C = np.arange(WINDOW + 1, dtype=float)
_WEIGHT = np.where(_C > 0, _C * np.log2(np.maximum(_C, 1)), 0.0)
_GAIN = np.rint(np.diff(_WEIGHT) * (1 << 20)).astype(np.int64)  # when a count grows by one


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        step = np.uint64(pow(base, done, 1 << 64))
        out[done:2 * done] = out[:min(done, n - done)] * step
        done *= 2
    return out


_TABLES: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n at least; kept per Python worker."""
    if not _TABLES or len(_TABLES[0]) < n:
        size = 1 << max(16, n.bit_length())
        _TABLES[:] = [_powers(BASE, size), _powers(pow(BASE, -1, 1 << 64), size)]
    return _TABLES[0], _TABLES[1]


def window_ranks(x: np.ndarray, start: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Improbability of the window that begins at each byte (start: each byte's first byte)."""
    n = len(x)
    gap = 2 * WINDOW
    kind, shift = (np.int32, 22) if n + gap * (int(doc[-1]) + 1) < 1 << 22 else (np.int64, 40)
    order = np.argsort(x, kind="stable")
    key = (np.arange(n, dtype=kind) + doc.astype(kind) * kind(gap))[order]
    key += x[order].astype(kind) << kind(shift)
    ahead, behind = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for d in range(1, WINDOW):
        near = (key[d:] - key[:-d]) < WINDOW
        if not near.any():
            break
        ahead[:-d] += near
        behind[d:] += near
    gone, come = np.zeros(n + 1, np.int64), np.zeros(n + WINDOW + 1, np.int64)
    gone[1:][order], come[1:n + 1][order] = _GAIN[ahead], _GAIN[behind]
    np.cumsum(gone, out=gone)
    np.cumsum(come, out=come)
    held = come[WINDOW:n + WINDOW] - gone[:n]
    held -= (come[:n + 1] - gone)[start]
    held -= int((6.0 - USUAL_ENTROPY) * WINDOW * (1 << 20))
    return np.abs(held) // (WINDOW * (1 << 20) // 1024)  # in 1/1024 bits


def features(texts: list[bytes]) -> list[np.ndarray]:
    """Distinct 64-bit features of each text, in the order of the text."""
    short = [np.array([xxhash.xxh64_intdigest(t)], np.uint64) if 0 < len(t) < WINDOW else None
             for t in texts]
    long = _window_features([b"" if 0 < len(t) < WINDOW else t for t in texts])
    return [a if a is not None else b for a, b in zip(short, long, strict=True)]


def _window_features(texts: list[bytes]) -> list[np.ndarray]:
    """``features`` of texts that are empty or hold a window at least."""
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    x = np.frombuffer(b"".join(texts), np.uint8)
    n = len(x)
    none = np.zeros(0, np.uint64)
    if not n:
        return [none] * len(texts)
    doc = np.repeat(np.arange(len(texts)), sizes)
    start = first[:-1][doc]
    ranks = window_ranks(x, start, doc)
    whole = np.arange(n) + WINDOW <= first[1:][doc]
    # the largest key is the highest rank, and the first of equals
    best = np.full(n + 2 * WINDOW - 2, -1, np.int64)  # a text's last 63 places keep it from the next
    best[WINDOW - 1:n + WINDOW - 1] = np.where(
        whole, (ranks + 1 << 32) - np.arange(n, dtype=np.int64), -1)
    span = 1
    while span < WINDOW:
        best = np.maximum(best[:-span], best[span:])
        span *= 2
    best = best[best >= 0]
    votes = np.bincount((-best) & 0xFFFFFFFF, minlength=n)
    at = np.flatnonzero(votes >= MIN_VOTES)
    # polynomial hash of the chosen windows
    power, inverse = powers(n)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((x + np.uint64(1)) * power[:n])])
    h = (total[at + WINDOW] - total[at]) * inverse[at]
    for shift, mult in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(mult)
    h ^= h >> np.uint64(33)
    owner = doc[at]
    keep = np.sort(np.unique(np.stack([owner.astype(np.uint64), h], axis=1), axis=0,
                             return_index=True)[1]) if len(h) else np.zeros(0, np.int64)
    owner, h = owner[keep], h[keep]
    cut = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [h[cut[i]:cut[i + 1]] for i in range(len(texts))]


def filters(found: np.ndarray) -> np.ndarray:
    """Chain of Bloom filters as rows of booleans."""
    k = -(-len(found) // FILTER_FEATURES)
    out = np.zeros((k, FILTER_BITS), bool)
    row = np.arange(len(found)) // FILTER_FEATURES
    for i in range(FEATURE_BITS):
        out[row, (found >> np.uint64(11 * i)).astype(np.int64) & (FILTER_BITS - 1)] = True
    return out


def as_text(chain: np.ndarray) -> str:
    return f"{len(chain)}:" + base64.b64encode(np.packbits(chain, axis=None).tobytes()).decode()


def from_text(fingerprint: str) -> np.ndarray:
    k, _, body = fingerprint.partition(":")
    bits = np.unpackbits(np.frombuffer(base64.b64decode(body), np.uint8)).astype(bool)
    return bits.reshape(int(k), FILTER_BITS)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 (no more in common than by chance) to 1 (equal)."""
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    x, y = a.astype(np.float32), b.astype(np.float32)
    nx, ny = x.sum(1)[:, None], y.sum(1)[None, :]
    chance, most = nx * ny / FILTER_BITS, np.minimum(nx, ny)
    score = np.clip((x @ y.T - chance) / np.maximum(most - chance, 1e-6), 0.0, 1.0)
    one = float((score.max(1) * nx[:, 0]).sum() / nx.sum())
    if len(a) == len(b):
        other = float((score.max(0) * ny[0]).sum() / ny.sum())
        one = (one + other) / 2
    return min(1.0, max(0.0, one))


def chains(texts: list[str]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    run: list[bytes] = []
    held = 0
    for t in texts:
        run.append(t.encode("utf-8", "surrogatepass"))
        held += len(run[-1])
        if held >= STEP_BYTES:
            out += map(filters, features(run))
            run, held = [], 0
    return out + [*map(filters, features(run))]


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Per row: fingerprints of the text and of its edited text, and how alike they are."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    least = -(1 << 63)
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("i"))
    cuts = ids.agg(F.percentile_approx("i", [k / parts for k in range(1, parts)] or [0.5], 10_000)
                   .alias("c")).first()["c"] or []
    cuts = np.unique(np.array(cuts[:parts - 1], np.int64))

    def part_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for i in batches:
            yield pd.Series(np.searchsorted(cuts, i.to_numpy(), "left").astype(np.int32))

    part = F.pandas_udf(part_of, "int")
    firsts = sorted((r["p"], r["f"]) for r in  # one row for each part
                    ids.groupBy(part("i").alias("p")).agg(F.min("i").alias("f")).collect())
    if not firsts:
        return spark.createDataFrame([], _schema(kind))
    before = {f: firsts[k - 1][0] for k, (_, f) in enumerate(firsts)}  # the last part is before the first
    first_ids = np.array(sorted(before), np.int64)
    goes_to = np.array([before[f] for f in first_ids.tolist()], np.int64)

    def places(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        """2 p for the row's own part p, 2 p + 1 as the row after part p."""
        for i in batches:
            i = i.to_numpy()
            own = np.searchsorted(cuts, i, "left") * 2
            k = np.minimum(np.searchsorted(first_ids, i), len(first_ids) - 1)
            also = first_ids[k] == i
            yield pd.Series([[a, b] if c else [a] for a, b, c in
                             zip(own.tolist(), (goes_to[k] * 2 + 1).tolist(), also.tolist(), strict=True)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the part's last row so far: (part, doc_id, text, chain)
        done = -1    # the part that has got its following row
        for batch in batches:
            rows = [] if held is None else [held]
            texts = batch["t"].tolist()
            for place, i, t, chain in zip(batch["place"].tolist(), batch["doc_id"].tolist(), texts,
                                          chains(texts), strict=True):
                rows.append((place, None if pd.isna(i) else int(i), t, chain))
            pairs = []
            for a, b in zip(rows, rows[1:], strict=False):
                if a[0] % 2 or a[0] // 2 == done:
                    continue
                assert a[0] // 2 == b[0] // 2, "a part without its following row"
                pairs.append((a, b))
                if b[0] % 2:
                    done = a[0] // 2
            held = rows[-1] if rows else None
            changed = [edited(a[2], b[2]) for a, b in pairs]
            new = chains(changed)
            yield pd.DataFrame({
                "doc_id": pd.array([a[1] for a, _ in pairs], "Int64"),
                "n_chars": [len(a[2]) for a, _ in pairs],
                "edited_sha256": [hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest()
                                  for c in changed],
                "fingerprint": [as_text(a[3]) for a, _ in pairs],
                "edited_fingerprint": [as_text(c) for c in new],
                "near_edited": [likeness(a[3], c) for (a, _), c in zip(pairs, new, strict=True)],
                "near_next": [likeness(a[3], b[3]) for a, b in pairs]})

    read = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("i"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    placed = read.withColumn("place", F.explode(F.pandas_udf(places, "array<long>")("i")))
    dealt = (placed.repartitionById(parts, F.expr("cast(place div 2 as int)"))
             .sortWithinPartitions("place", "i", "t"))
    return dealt.select("place", "doc_id", "t").mapInPandas(run, _schema(kind))


def _schema(kind: str) -> str:
    return (f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, "
            "edited_fingerprint string, near_edited double, near_next double")
