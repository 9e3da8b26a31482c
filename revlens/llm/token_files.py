"""Token ids as flat binary files with 64-bit document offsets.

Layout of a folder: per segment ``<name>.bin`` (unsigned little-endian integers, 16 bits wide
if the vocabulary allows it, else 32) and ``<name>.idx`` (int64: n + 1 offsets into the
segment, then n document ids), and ``manifest.json``, which names the segments in ascending
document order with their bases. Bases are prefix sums over the segments' sizes: one number
per segment reaches the driver, never one per document.

Writing: documents are dealt by ranges of the id and sorted inside each range; each task
writes its own segment under a name of its own attempt, and only the names that successful
tasks return go into the manifest. So a lost executor or a task that runs twice leaves a
stray file at most. Reading memory-maps the segments (local file systems) or opens them
through their file system (others).

Cases: null text is empty and has the end id only; a text above ``words.STEP`` bytes goes through in
parts; an empty table gives a manifest without
segments and no rows; a null id comes first and is given back as null; rows of equal ids are
kept side by side; other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm.bpe import byte_symbols
from revlens.llm.common import give_back_memory, open_fs, shared_folder
from revlens.llm.words import pieces

MEMO_RUNS = 400_000       # text runs asked for lately, remembered per Python worker
NULL_ID = np.iinfo(np.int64).min
LOOSE_ASCII = re.compile(b"(?<=[!-~]) (?=[!-~])")  # where a very long text is cut
SPACE, LETTER, DIGIT, SIGN, OTHER, CONTROL = range(6)
#: What a byte is; OTHER: beyond ASCII, or a part of contractions (') and special tokens (<).
KIND = np.array([SPACE if b == 32 else CONTROL if b < 32 or b == 127 else OTHER if b > 127 or b in b"'<"
                 else LETTER if chr(b).isalpha() else DIGIT if chr(b).isdigit() else SIGN
                 for b in range(256)], np.uint8)
#: A whole token of the pre-tokenizer.
ONE_KIND = re.compile("[ ]?(?:[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+|[0-9]+|[!-&(-/:;=-@\\[-`{-~]+)")
LATIN_1 = 0xC3  # first byte of the letters from U+00C0 to U+00FF


def parted(texts: pa.Array) -> pa.Array:
    """The texts with a zero byte wherever a byte-level pre-tokenizer always cuts and the bytes
    show it: before a single space between two characters that are no white space, and between
    letters, digits and signs of an ASCII run without contractions and special tokens."""
    offsets = np.frombuffer(texts.buffers()[1], "<i8", len(texts) + 1)
    text = np.frombuffer(texts.buffers()[2], np.uint8)
    n = len(text)
    if not n:
        return texts
    kind = KIND[text]
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    space = kind == SPACE
    run = np.cumsum(space | begins[:-1], dtype=np.int32)
    plain = (np.bincount(run[kind == OTHER], minlength=int(run[-1]) + 1) == 0)[run]
    ink = (kind >= LETTER) & (kind <= SIGN)
    dark = ink | (text == ord("'")) | (text == ord("<"))
    before, after = dark.copy(), dark | (text == LATIN_1)
    before[1:] |= text[:-1] == LATIN_1
    cut = np.zeros(n, bool)
    cut[1:] = plain[1:] & ink[1:] & ink[:-1] & (kind[1:] != kind[:-1])
    cut[1:-1] |= space[1:-1] & before[:-2] & after[2:] & ~begins[2:-1]
    cut &= ~begins[:-1]
    place = np.cumsum(cut, dtype=np.int64) + np.arange(n)
    out = np.zeros(int(place[-1]) + 1, np.uint8)
    out[place] = text
    ends = np.append(place - cut, len(out))[offsets]
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends.astype("<i8")), pa.py_buffer(out))


# the pre-tokenizer that the cuts are right for
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


class RunEncoder:
    """The tokenizers library behind a memo of runs of text.

    Texts are cut where the pre-tokenizer always cuts, a step of texts at a time (``parted``), and
    the runs are numbered by Arrow. Distinct runs are encoded once while they stay in the memo,
    and the ids of all texts are gathered from the runs' by array operations. When the memo is
    full, the runs that were met in one step only go.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.cuts = spec["normalizer"] is None and spec["pre_tokenizer"] == BYTE_LEVEL
        self.model, self.symbols = self.tokenizer.model, dict(enumerate(byte_symbols()))
        wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.kind = np.dtype("<u4" if wide else "<u2")
        self.place: dict[str, int] = {}
        self.start = self.size = self.met = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after the other, and their numbers."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def _encode_runs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_encode``; runs that are one token of the pre-tokenizer go to the model directly."""
        whole = [ONE_KIND.fullmatch(r) is not None and self.cuts for r in runs]
        tokenize, to_symbols = self.model.tokenize, self.symbols
        ids, size = [], []
        for run, x in zip(runs, whole, strict=True):
            if x:
                found = tokenize(run.encode().decode("latin-1").translate(to_symbols))
                ids += [t.id for t in found]
                size.append(len(found))
        one = np.array(whole, bool)
        other, other_size = self._encode([r for r, x in zip(runs, whole, strict=True) if not x])
        sizes = np.zeros(len(runs), np.int64)
        sizes[one], sizes[~one] = size, other_size
        out = np.zeros(sizes.sum(), np.uint32)
        of_one = np.repeat(one, sizes)
        out[of_one], out[~of_one] = ids, other
        return out, sizes

    def _keep(self, kept: np.ndarray) -> None:
        """Only the memo's entries ``kept`` stay."""
        number = np.full(len(self.size), -1)
        number[kept] = np.arange(len(kept))
        self.place = {r: n for r, n in zip(self.place, number[list(self.place.values())].tolist(), strict=True)
                      if n >= 0}
        size = self.size[kept]
        ends = np.cumsum(size)
        self.ids = self.ids[np.repeat(self.start[kept] - (ends - size), size) + np.arange(size.sum())]
        self.start, self.size, self.met = ends - size, size, self.met[kept] // 2

    def _places(self, runs: list[str]) -> np.ndarray:
        """Where the memo holds each run; those it doesn't hold are encoded first."""
        new = [r for r in runs if r not in self.place]
        if len(self.place) + len(new) > MEMO_RUNS:
            self._keep(np.flatnonzero(self.met > 1))
            if len(self.place) + len(new) > MEMO_RUNS:
                self._keep(np.zeros(0, np.int64))
            new = [r for r in runs if r not in self.place]
        flat, size = self._encode_runs(new)
        self.place.update(zip(new, range(len(self.size), len(self.size) + len(new)), strict=True))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
        self.size, self.ids = np.concatenate([self.size, size]), np.concatenate([self.ids, flat])
        self.met = np.concatenate([self.met, np.zeros(len(new), np.int64)])
        at = np.fromiter(map(self.place.__getitem__, runs), np.int64, len(runs))
        self.met[at] += 1
        return at

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of each text; ``end_id`` is put
        after every text."""
        n = len(texts)
        zeros = pc.any(pc.match_substring(texts, "\0")).as_py()
        if zeros or not self.cuts:
            flat, sizes = self._encode(texts.to_pylist())
            codes, offsets, start, size = np.arange(n), np.arange(n + 1), np.cumsum(sizes) - sizes, sizes
        else:
            lists = pc.split_pattern(parted(texts), "\0")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            coded = lists.flatten().dictionary_encode()
            codes = coded.indices.to_numpy()
            at = self._places(coded.dictionary.to_pylist())
            flat, start, size = self.ids, self.start[at], self.size[at]
        start, size = start[codes], size[codes]
        if end_id is not None:
            size, start = np.insert(size, offsets[1:], 1), np.insert(start, offsets[1:], len(flat))
            offsets, flat = offsets + np.arange(n + 1), np.append(flat, np.uint32(end_id))
        total = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(start - total[:-1], size) + np.arange(total[-1])
        return flat[at], np.diff(total[offsets])

    def steps(self, column: pa.Array, end_id: int) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """(ids, first row, ids of each row); a row above a step's bytes comes in several."""
        for p in pieces(column, None, cut=LOOSE_ASCII):
            ids, sizes = self.encode(p.texts, None if p.more else end_id)
            yield ids.astype(self.kind), p.first, sizes

    def texts(self, texts: list[str], end_id: int) -> list[bytes]:
        """Ids of each text and the end id, as little-endian bytes."""
        out = [b""] * len(texts)
        for ids, first, sizes in self.steps(pa.array(texts, pa.large_string()), end_id):
            for k, x in enumerate(np.split(ids, np.cumsum(sizes)[:-1])):
                out[first + k] += x.tobytes()
        return out


_ENCODERS: dict[str, RunEncoder] = {}


def run_encoder(path: str) -> RunEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = RunEncoder(path)
    return _ENCODERS[path]


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int = 0,
                      id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Encode every text with the vocabulary file ``path`` and write ``folder``; the manifest."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = run_encoder(path)
        fs, at = open_fs(folder)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        sizes: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        out = None
        for batch in batches:
            if out is None:
                fs.create_dir(at, recursive=True)
                out = fs.open_output_stream(f"{at}/{name}.bin")
            n = np.zeros(batch.num_rows, np.int64)
            for tokens, first, found in enc.steps(batch.column(1), end_id):
                out.write(tokens.tobytes())
                n[first:first + len(found)] += found
            sizes.append(n)
            ids.append(batch.column(0).fill_null(NULL_ID).to_numpy())
        give_back_memory()
        if out is None:
            return
        out.close()
        offsets = np.concatenate([[0], *sizes]).astype("<i8").cumsum(dtype="<i8")
        with fs.open_output_stream(f"{at}/{name}.idx") as f:
            f.write(offsets.tobytes() + np.concatenate(ids).astype("<i8").tobytes())
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([task.partitionId()], pa.int32()), "name": [name], "n_docs": [len(offsets) - 1],
            "n_tokens": [int(offsets[-1])], "width": pa.array([enc.kind.itemsize], pa.int32())})

    read = docs.select(F.col(id_col).cast("long").alias("i"),
                       F.col(text_col).cast("string").alias("t"))
    # rows of one id are dealt over several ranges by their texts
    order = [F.col("i").asc_nulls_first(), F.xxhash64("t")]
    ranged = read.repartitionByRange(*order).sortWithinPartitions(*order, "t")
    segments = ranged.mapInArrow(
        write, "part int, name string, n_docs long, n_tokens long, width int").collect()
    base, listed = 0, []
    for s in sorted(segments, key=lambda s: s["part"]):
        listed.append({"name": s["name"], "base": base, "n_docs": s["n_docs"],
                       "n_tokens": s["n_tokens"], "width": s["width"]})
        base += s["n_tokens"]
    manifest = {"segments": listed, "n_tokens": base, "end_id": end_id}
    fs, at = open_fs(folder)
    fs.create_dir(at, recursive=True)
    with fs.open_output_stream(f"{at}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def mapped(folder: str, name: str, dtype) -> np.ndarray:
    """A file's integers: memory-mapped where the file system is local."""
    from pyarrow import fs as pafs
    from pyarrow import memory_map

    fs, at = open_fs(folder)
    path = f"{at}/{name}"
    if isinstance(fs, pafs.LocalFileSystem):
        if not os.path.getsize(path):
            return np.zeros(0, dtype)
        return np.frombuffer(memory_map(path).read_buffer(), dtype)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 (ids as 32-bit LE)."""
    fs, at = open_fs(folder)
    with fs.open_input_stream(f"{at}/manifest.json") as f:
        segments = json.loads(f.read())["segments"]
    schema = "name string, base long, n_docs long, n_tokens long, width int"
    rows = [(s["name"], s["base"], s["n_docs"], s["n_tokens"], s["width"]) for s in segments]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in batch.itertuples(index=False):
                index = mapped(folder, f"{s.name}.idx", "<i8")
                tokens = mapped(folder, f"{s.name}.bin", "<u2" if s.width == 2 else "<u4")
                offsets, ids = index[: s.n_docs + 1], index[s.n_docs + 1:]
                for lo in range(0, s.n_docs, 20_000):
                    hi = min(lo + 20_000, s.n_docs)
                    crc = [zlib.crc32(tokens[a:b].astype("<u4").tobytes())
                           for a, b in zip(offsets[lo:hi], offsets[lo + 1:hi + 1], strict=True)]
                    yield pd.DataFrame({
                        "doc_id": pd.Series(ids[lo:hi], dtype="Int64").mask(
                            pd.Series(ids[lo:hi] == NULL_ID)),
                        "start": s.base + offsets[lo:hi],
                        "n_tokens": np.diff(offsets[lo:hi + 1]), "ids_crc32": crc})

    listed = spark.createDataFrame(rows, schema).repartition(max(1, len(rows)))
    return listed.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_table(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """Write the files below the shared folder and read them back."""
    folder = shared_folder(docs.sparkSession, "tokens")
    write_token_files(docs, path, folder, end_id)
    return read_token_files(docs.sparkSession, folder)
