"""BPE encoding and decoding with a contiguous rank array.

For every short word the part boundaries and the ranks of adjacent parts are held in two
contiguous arrays. The smallest rank is looked for again and again, its right boundary is
deleted, and only the two neighbouring ranks are refreshed. Words of equal length are kept as
rows of one matrix, so that each step (scan, delete, refresh) is one array operation over many
words. Words above ``LONG_WORD`` bytes, where rescanning would cost the square of the length,
use a heap over the same ranks and give the same ids.

A word is encoded once per Python worker while it stays in the (bounded) memo; a text is
split at spaces and put together from its words' ids.

Results equal the ``tokenizers`` library's for a lower-casing word-end BPE file (NFC, white
space dropped, byte-level symbols, ``</w>``): special tokens in the text keep their id, and
decoding without a decoder joins the tokens' strings by spaces.

Cases: null text counts as empty; an empty text or one of white space only has no tokens and
hashes of the empty string; null ``doc_id`` stays null; repeated rows give repeated results;
columns other than the id and the text are not read, so clashing names don't matter.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import give_back_memory

LONG_WORD = 200          # bytes; longer words use the heap
MEMO_WORDS = 400_000     # words remembered per Python worker
STEP_CHARS = 1_000_000   # texts are handled in runs of about this many characters
NO_RANK = np.iinfo(np.int32).max


def byte_symbols() -> list[str]:
    """Printable stand-in of every byte: itself where printable, else 256 onwards in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class RankArrayBPE:
    """Encoder and decoder of one vocabulary file; built once per Python worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        kinds = json.dumps(spec["normalizer"])
        if '"NFC"' not in kinds or '"Lowercase"' not in kinds:
            raise ValueError("the file is not of the lower-casing word-end kind")
        self.split = regex.compile(next(
            p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"]
            if p["type"] == "Split"))
        self.special_split = regex.compile(
            "(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        symbols = byte_symbols()
        self.first_id = np.array([vocab[s] for s in symbols], np.int32)
        self.last_id = np.array([vocab[s + self.end] for s in symbols], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self._index(left << 32 | right)
        self._memo: dict[str, int] = {}
        self._ids: list[str] = []
        self._text: list[str] = []
        self._n: list[int] = []

    # ---- ranks of pairs: an open-addressing table over the merge list -----------------
    def _index(self, keys: np.ndarray) -> None:
        self.bits = max(12, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NO_RANK, np.int32)
        slots = self._slot(keys).tolist()
        for rank, (key, slot) in enumerate(zip(keys.tolist(), slots, strict=True)):
            while self.keys[slot] not in (-1, key):
                slot = (slot + 1) & ((1 << self.bits) - 1)
            if self.keys[slot] == -1:
                self.keys[slot], self.ranks[slot] = key, rank

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        slots = self._slot(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.ranks[slots], NO_RANK).astype(np.int32)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while open_.size:
            slots[open_] = (slots[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slots[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[slots[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out

    # ---- words -------------------------------------------------------------------------
    def words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word (UTF-8 bytes, not empty)."""
        out: list[list[int]] = [[]] * len(words)
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_size.setdefault(len(w), []).append(i)
        for size, rows in by_size.items():
            if size > LONG_WORD:
                for i in rows:
                    out[i] = self._long(words[i])
            else:
                self._short(words, np.array(rows), size, out)
        return out

    def _short(self, words: list[bytes], rows: np.ndarray, size: int, out: list) -> None:
        raw = np.frombuffer(b"".join(words[i] for i in rows), np.uint8).reshape(-1, size)
        parts = self.first_id[raw]
        parts[:, -1] = self.last_id[raw[:, -1]]
        if size > 1:
            ranks = self.rank(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(-1, size - 1)
        while True:
            width = parts.shape[1]
            if width > 1:
                at = ranks.argmin(axis=1)
                best = ranks[np.arange(len(rows)), at]
                done = best == NO_RANK
            else:
                done = np.ones(len(rows), bool)
            for i, ids in zip(rows[done].tolist(), parts[done].tolist(), strict=True):
                out[i] = ids
            if done.all():
                return
            if done.any():
                rows, parts, ranks = rows[~done], parts[~done], ranks[~done]
                at, best = at[~done], best[~done]
            n = np.arange(len(rows))
            parts[n, at] = self.merged[best]
            keep = np.ones(parts.shape, bool)
            keep[n, at + 1] = False
            parts = parts[keep].reshape(len(rows), width - 1)
            keep = np.ones(ranks.shape, bool)
            keep[n, at] = False
            ranks = ranks[keep].reshape(len(rows), width - 2)
            has = np.flatnonzero(at > 0)
            ranks[has, at[has] - 1] = self.rank(parts[has, at[has] - 1], parts[has, at[has]])
            has = np.flatnonzero(at < width - 2)
            ranks[has, at[has]] = self.rank(parts[has, at[has]], parts[has, at[has] + 1])

    def _long(self, word: bytes) -> list[int]:
        raw = np.frombuffer(word, np.uint8)
        parts = self.first_id[raw]
        parts[-1] = self.last_id[raw[-1]]
        first = self.rank(parts[:-1], parts[1:])
        ids, n = parts.tolist(), len(word)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != NO_RANK]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j == -1 or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.merged[rank]), -1
            right[i] = right[j]
            if right[j] != -1:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x != -1 and y != -1:
                    r = int(self.rank(np.array([ids[x]]), np.array([ids[y]]))[0])
                    if r != NO_RANK:
                        heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [x for x in ids if x != -1]

    # ---- texts ---------------------------------------------------------------------------
    def _pieces(self, chunk: str) -> list[bytes | int]:
        """Words (bytes) and special ids of a run of text without spaces."""
        if chunk.isascii():
            if "<|" not in chunk:
                return [w.encode() for w in self.split.findall(chunk.lower())]
            parts = self.special_split.split(chunk)
        else:
            parts = self.special_split.split(chunk)
        out: list[bytes | int] = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.special[part])
            elif part:
                out += [w.encode() for w in self.split.findall(lowered(part))]
        return out

    def learn(self, chunks: set[str]) -> None:
        """Encode the runs that the memo doesn't hold yet."""
        new = [c for c in chunks if c not in self._memo]
        pieces = [self._pieces(c) for c in new]
        words = {w: None for p in pieces for w in p if isinstance(w, bytes)}
        encoded = dict(zip(words, self.words(list(words)), strict=True))
        for chunk, p in zip(new, pieces, strict=True):
            ids = [i for w in p for i in (encoded[w] if isinstance(w, bytes) else (w,))]
            self._memo[chunk] = len(self._n)
            self._n.append(len(ids))
            self._ids.append(" ".join(map(str, ids)))
            self._text.append(self.decode(ids))

    def forget(self) -> None:
        self._memo, self._ids, self._text, self._n = {}, [], [], []

    def decode(self, ids: list[int]) -> str:
        """As the library decodes without a decoder: the tokens' strings, joined by spaces."""
        token = self.token
        return " ".join([token[i] for i in ids if i in token])

    def encode(self, text: str | None) -> list[int]:
        chunks = (text or "").replace("\n", " ").split(" ")
        self.learn(set(chunks))
        return [int(i) for c in chunks for i in self._ids[self._memo[c]].split()]

    def digests(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """(number of tokens, ids' hash, decoded text's hash) of each text."""
        run: list[list[str]] = []
        held = 0
        for text in texts:
            run.append((text or "").replace("\n", " ").split(" "))
            held += len(text or "")
            if held >= STEP_CHARS:
                yield from self._digest_run(run)
                run, held = [], 0
        yield from self._digest_run(run)

    def _digest_run(self, run: list[list[str]]) -> Iterator[tuple[int, str, str]]:
        if len(self._memo) > MEMO_WORDS:
            self._memo, self._ids, self._text, self._n = {}, [], [], []
        self.learn(set().union(*run) if run else set())
        at, n, ids, text = self._memo.__getitem__, self._n, self._ids, self._text
        for chunks in run:
            k = [*map(at, chunks)]
            joined = " ".join(filter(None, map(ids.__getitem__, k)))
            decoded = " ".join(filter(None, map(text.__getitem__, k)))
            yield (sum(map(n.__getitem__, k)), hashlib.sha256(joined.encode()).hexdigest(),
                   hashlib.sha256(decoded.encode()).hexdigest())


def lowered(text: str) -> str:
    """NFC, then lower case character by character (no final-sigma rule), as the library does."""
    import unicodedata

    text = unicodedata.normalize("NFC", text)
    if "Σ" in text:  # the only letter whose lower case depends on its neighbours
        text = text.replace("Σ", "σ")
    return text.lower()


_ENCODERS: dict[str, RankArrayBPE] = {}


def encoder(path: str) -> RankArrayBPE:
    """One encoder per Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = RankArrayBPE(path)
    return _ENCODERS[path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``. No shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = encoder(path)
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch["t"]]
            out = pd.DataFrame(list(bpe.digests(texts)), columns=names)
            out.insert(0, "doc_id", batch["i"].to_numpy())
            yield out
        bpe.forget()  # the worker goes on to other stages
        give_back_memory()

    read = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    return read.mapInPandas(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_ids(docs: DataFrame, path: str, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id and the array of token ids themselves."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = encoder(path)
        for batch in batches:
            ids = []
            for t in batch["t"]:
                if len(bpe._memo) > MEMO_WORDS:
                    bpe._memo, bpe._ids, bpe._text, bpe._n = {}, [], [], []
                ids.append(bpe.encode(t if isinstance(t, str) else None))
            yield pd.DataFrame({"doc_id": batch["i"].to_numpy(), "ids": ids})

    read = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    return read.mapInPandas(run, f"doc_id {kind}, ids array<int>")


def decode_ids(tokens: DataFrame, path: str) -> DataFrame:
    """Inverse of ``token_ids``: (doc_id, ids) to (doc_id, text)."""
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = encoder(path)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), "text": [
                bpe.decode(list(map(int, x))) if x is not None else "" for x in batch["ids"]]})

    return tokens.select("doc_id", "ids").mapInPandas(run, f"doc_id {kind}, text string")
