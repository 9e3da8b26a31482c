"""Token counts of every prefix, by dynamic programming over a BPE vocabulary.

The BPE encoding of a word without its last token is the encoding of the rest, and a row of
tokens is an encoding exactly where each two neighbours are one by themselves. So for every
prefix one token, the last of its encoding, is enough: it is the vocabulary's only token that
ends there and agrees with the last token of the prefix before it, and the prefix's count is that
prefix's count plus one. Two tokens agree if merging never crosses their boundary, which is seen
by undoing their own merges from the latest on (``Vocabulary.agree``).

A word-end vocabulary spells a word's last symbol differently. Prefixes are therefore held
twice: as the inside of a longer word (the table of the recursion) and as a word that ends there
(the stored count). New words are worked out in sorted order, so that prefixes they share are
worked out once. Counts of all prefixes of a word are kept as long as the memo holds it; the
count of a text, of any of its prefixes, and the longest prefix within a budget are sums of
stored counts, so nothing is encoded again for another budget.

Counts equal the ``tokenizers`` library's for a lower-casing word-end BPE file (NFC, white space
dropped, byte-level symbols, ``</w>``); special tokens inside a text count as one.

Cases: null text counts as empty; an empty text or one of white space only has no tokens; null
ids stay null; repeated rows give repeated results; only the id and the text are read. A text
above ``words.STEP`` bytes is counted in parts cut at spaces; a single word of any length takes
time in proportion to it.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import give_back_memory, sliced
from revlens.llm.words import SPACES, numbered, pieces

LIMIT = 2048
MEMO_WORDS = 500_000     # words whose prefix counts are remembered per Python worker
MEMO_RUNS = 300_000      # runs of text without spaces whose counts are remembered
MEMO_PAIRS = 1_000_000   # pairs of tokens known to agree or not
NONE = -1
#: Bytes of runs that need a look as text: beyond ASCII, contractions, special tokens.
ODD = regex.compile(b"[\\x80-\\xff'<]")
KIND = np.array([0 if b == 32 else 4 if b > 127 or b in b"'<" else 1 if chr(b).isalpha() else 2
                 if chr(b).isdigit() else 3 for b in range(256)], np.uint8)
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
SPACE = regex.compile("([\t\n\v\f\r ])")
#: A character and the marks (or the vowels and finals of a Korean syllable) that may compose with it.
CLUSTER = regex.compile("[^\\p{M}\u1160-\u11ff][\\p{M}\u1160-\u11ff]*|[\\p{M}\u1160-\u11ff]+")


def symbols() -> list[str]:
    """The printable stand-in of every byte."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256)]


class Vocabulary:
    """Merges as trees: of each token the rank of its last merge and the two tokens merged."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        kinds = json.dumps(spec["normalizer"])
        if not self.end or '"NFC"' not in kinds or '"Lowercase"' not in kinds:
            raise ValueError("the file is not of the lower-casing word-end kind")
        self.pattern = regex.compile(next(
            p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        specials = sorted((x["content"] for x in spec["added_tokens"]), key=len, reverse=True)
        self.specials = regex.compile("|".join(map(regex.escape, specials)) or r"(?!)")
        vocab: dict[str, int] = model["vocab"]
        made: dict[int, list[tuple[int, int, int]]] = {}
        self.merge: dict[int, int] = {}  # pair to rank
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            a, b, both = vocab[a], vocab[b], vocab[a + b]
            if self.merge.setdefault(a << 32 | b, rank) == rank:
                made.setdefault(both, []).append((rank, a, b))
        size = max(vocab.values()) + 1
        self.rank, self.left, self.right = [NONE] * size, [NONE] * size, [NONE] * size
        self.known: dict[int, bool] = {}  # pairs that were asked for lately
        whole: set[int] = set()  # tokens that the encoding of their own text is
        for text, token in vocab.items():
            if len(text.removesuffix(self.end) or text) == 1 and token not in made:
                whole.add(token)
        for token in sorted(made, key=lambda t: made[t][0]):
            for rank, a, b in made[token]:
                if a in whole and b in whole and self._crossed(a, b) == rank:
                    self.rank[token], self.left[token], self.right[token] = rank, a, b
                    whole.add(token)
        byte = {s: chr(b) for b, s in enumerate(symbols())}
        bodies: dict[str, list[int]] = {}  # bytes (as Latin-1) to the tokens inside and at a word's end
        for text, token in vocab.items():
            if token in whole:
                ends = text.endswith(self.end) and len(text) > len(self.end)
                body = "".join(byte[c] for c in (text[:-len(self.end)] if ends else text))
                bodies.setdefault(body, [NONE, NONE])[ends] = token
        self.endings = ahocorasick.Automaton()  # all tokens that end at a place of a word
        for body, (inner, final) in bodies.items():
            self.endings.add_word(body, (len(body), inner, final))
        self.endings.make_automaton()

    def _crossed(self, a: int, b: int) -> int | None:
        """The rank of the first merge across the boundary of a and b; None if there is none."""
        rank, merge = self.rank, self.merge
        found, limit = None, None  # later merges are undone first, so the last found comes first
        while True:
            r = merge.get(a << 32 | b)
            if r is not None and (limit is None or r < limit):
                found = r
            # of two equal ranks the left one is merged first; a crossing of the rank of the left
            # token's merge comes after it, of the right token's before it
            if rank[a] > rank[b]:
                limit, a = rank[a], self.right[a]
            elif rank[b] != NONE:
                limit, b = rank[b] + 1, self.left[b]
            else:
                return found

    def agree(self, a: int, b: int) -> bool:
        if len(self.known) >= MEMO_PAIRS:
            self.known.clear()
        known = self.known[a << 32 | b] = self._crossed(a, b) is None
        return known


class PrefixCounts:
    """Counts of the prefixes of words and of runs of text; built once per Python worker."""

    def __init__(self, path: str):
        self.vocab = Vocabulary(path)
        self.words: dict[bytes, bytes | array] = {}
        self.run_counts: dict[bytes, int] = {}

    def make_room(self, coming: int) -> None:
        if len(self.words) + coming > MEMO_WORDS or len(self.run_counts) + coming > MEMO_RUNS:
            self.words, self.run_counts = {}, {}

    # ---- words: UTF-8 bytes of one match of the pattern ---------------------------------
    def word(self, word: bytes) -> bytes | array:
        """[k]: number of tokens of the first k bytes, taken as a word."""
        if word not in self.words:
            self.make_room(1)
            self._learn({word})
        return self.words[word]

    def _learn(self, words: set[bytes]) -> None:
        """Fill the tables of new words. In sorted order a word goes on from the columns of the
        prefix that it shares with the one before, so a shared prefix is worked out once."""
        known, agree, held = self.vocab.known.get, self.vocab.agree, self.words
        new = sorted(w for w in words if w not in held)
        last, inside, ended = [NONE], [0], [0]
        for word, shared in zip(new, shared_prefixes(new), strict=True):
            n = len(word)
            last[shared + 1:] = [NONE] * (n - shared)
            inside[shared + 1:] = [0] * (n - shared)
            ended[shared + 1:] = [0] * (n - shared)
            for end, (size, inner, final) in self.vocab.endings.iter(word.decode("latin-1")):
                if end < shared:
                    continue
                i = end + 1
                j = i - size
                before = last[j] << 32
                if final >= 0 and not ended[i]:
                    fits = j == 0 or known(before | final)
                    if fits is None:
                        fits = agree(last[j], final)
                    if fits:
                        ended[i] = inside[j] + 1
                if inner >= 0 and not inside[i]:
                    fits = j == 0 or known(before | inner)
                    if fits is None:
                        fits = agree(last[j], inner)
                    if fits:
                        last[i], inside[i] = inner, inside[j] + 1
            held[word] = bytes(ended) if n < 256 else array("I", ended)

    # ---- runs: text without ASCII white space, as ``parted`` leaves it --------------------
    def runs(self, runs: list[bytes]) -> list[int]:
        """Number of tokens of each run."""
        self.make_room(len(runs))
        words, counts = self.words, self.run_counts
        new = [r for r in runs if r not in words and r not in counts]
        odd = {r: self._words(r.decode()) for r in new if ODD.search(r)}
        self._learn({r for r in new if r not in odd}.union(*(w for w, _ in odd.values())))
        for run, (found, specials) in odd.items():
            counts[run] = specials + sum([words[w][-1] for w in found])
        return [words[r][-1] if r in words else counts[r] for r in runs]

    def _words(self, run: str) -> tuple[list[bytes], int]:
        """The words of a run, and how many special tokens it holds."""
        find = self.vocab.pattern.findall
        if "<" not in run:
            return [w.encode() for w in find(normal(run))], 0
        words, specials = [], 0
        for part, special in self._parts(run):
            if special:
                specials += 1
            else:
                words += [w.encode() for w in find(normal(part))]
        return words, specials

    def _parts(self, run: str) -> Iterator[tuple[str, bool]]:
        at = 0
        if "<" in run:
            for m in self.vocab.specials.finditer(run):
                yield run[at:m.start()], False
                yield m.group(), True
                at = m.end()
        yield run[at:], False

    def prefixes(self, text: str | None) -> array:
        """[p]: number of tokens of the first p code points of the text."""
        out, before = array("I", [0]), 0
        for run in SPACE.split(text or ""):
            if SPACE.fullmatch(run):
                out.append(before)
                continue
            plain = ""
            for part, special in self._parts(run):
                if not special:
                    plain = part
                    out.extend(before + n for n in self._plain(part))
                    continue
                # cut inside it, the special token is text that goes on from the part before
                out.extend(before + n for n in self._plain(plain + part[:-1])[len(plain):])
                before += (self._plain(plain) or [0])[-1] + 1
                out.append(before)
                plain = ""
            before += (self._plain(plain) or [0])[-1]
        return out

    def _plain(self, part: str) -> list[int]:
        """Counts of the prefixes of 1, 2, ... code points of a part without special tokens."""
        text, find, word = normal(part), self.vocab.pattern, self.word
        found = list(find.finditer(text))
        starts = [m.start() for m in found]
        held = [word(m.group().encode()) for m in found]
        before = [0, *accumulate(h[-1] for h in held)]
        out, at = [], 0
        for cluster in CLUSTER.findall(part):
            for k in range(1, len(cluster) + 1):
                piece = normal(cluster[:k])
                end = at + len(piece)
                # the word that the prefix ends in, or after
                w = bisect_left(starts, end if text.startswith(piece, at) else at) - 1
                if w < 0:
                    out.append(sum(word(x.encode())[-1] for x in find.findall(text[:at] + piece)))
                elif not text.startswith(piece, at) or found[w].group()[:1] == "'":
                    w -= w > 0 and text[starts[w] - 1] == "'"
                    cut = text[starts[w]:at] + piece  # a mark is cut off, or the rest of 's, 'll ...
                    out.append(before[w] + sum(word(x.encode())[-1] for x in find.findall(cut)))
                else:
                    inside = len(text[starts[w]:min(end, found[w].end())].encode())
                    out.append(before[w] + held[w][inside])
            at += len(normal(cluster))
        return out

    def truncated(self, text: str | None, budget: int) -> str:
        """The longest prefix of at most ``budget`` tokens; nothing is encoded for another budget."""
        counts = np.frombuffer(self.prefixes(text), np.uint32)
        return (text or "")[:int(np.flatnonzero(counts <= budget)[-1])]


def shared_prefixes(words: list[bytes], width: int = 24) -> list[int]:
    """Of sorted words, how many leading bytes each shares with the one before (up to ``width``)."""
    size = np.array([len(w) for w in words], np.int64)
    m = np.array(words, f"S{width}").view(np.uint8).reshape(len(words), width) if words else np.zeros((0, width))
    other = np.concatenate([m[1:] != m[:-1], np.ones((len(m[1:]), 1), bool)], axis=1).argmax(1)
    return [0, *np.minimum(other, np.minimum(size[1:], size[:-1])).tolist()][:len(words)]


def parted(texts: pa.Array) -> pa.Array:
    """Runs of plain ASCII in lower case, with spaces between letters, digits and other signs, as
    the pattern would cut them; runs with one of ``ODD`` stay as they are."""
    offsets = np.frombuffer(texts.buffers()[1], "<i8", len(texts) + 1)
    text = np.frombuffer(texts.buffers()[2], np.uint8)
    if not len(text):
        return texts
    kind = KIND[text]
    blank = kind == 0
    start = blank.copy()  # of a run: also where a text begins
    start[offsets[offsets < len(text)]] = True
    run = np.cumsum(start, dtype=np.int32)
    plain = (np.bincount(run[kind == 4], minlength=int(run[-1]) + 1) == 0)[run]
    cut = np.zeros(len(text), bool)
    cut[1:] = plain[1:] & ~blank[1:] & ~blank[:-1] & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))
    place = np.cumsum(cut, dtype=np.int64) + np.arange(len(text))
    out = np.full(int(place[-1]) + 1, 32, np.uint8)
    out[place] = np.where(plain, LOWER[text], text)
    ends = np.append(place, len(out))[offsets]
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends.astype("<i8")), pa.py_buffer(out))


def normal(text: str) -> str:
    """NFC, then lower case character by character (a final sigma is no exception)."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()


_COUNTERS: dict[str, PrefixCounts] = {}


def counter(path: str) -> PrefixCounts:
    """One per Python worker and file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounts(path)
    return _COUNTERS[path]


# ---- tables ------------------------------------------------------------------------------
def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit). No shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).runs
        for batch in batches:
            text = batch.column(1)
            total = np.zeros(batch.num_rows)
            for p in pieces(text, SPACES):
                w = numbered(parted(p.texts))
                each = np.array(count(w.dictionary.cast(pa.large_binary()).to_pylist()), float)
                total[p.first:p.first + len(p.texts)] += np.bincount(w.text, each[w.codes], len(p.texts))
            n = total.astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.binary_length(text).fill_null(0).cast(pa.int64()), pa.array(n),
                 pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])
        give_back_memory()

    read = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    return read.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def prefix_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, counts; counts[p] is the number of tokens of the first p code points."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes = counter(path).prefixes
        for batch in sliced(batches, 50):
            rows = [np.frombuffer(prefixes(t), np.uint32) for t in batch.column(1).to_pylist()]
            flat = np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, np.int32)
            ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "counts"])

    read = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    return read.mapInArrow(run, f"doc_id {kind}, counts array<int>")


def longest_prefix(counts: Column | str, budget: int) -> Column:
    """Code points of the longest prefix within the budget, from stored ``counts``; any budget
    is answered from the same table."""
    counts = F.col(counts) if isinstance(counts, str) else counts
    within = F.transform(counts, lambda n: n <= budget)
    return (F.size(counts) - F.array_position(F.reverse(within), True)).cast("long")


def within_budget(docs: DataFrame, path: str, budget: int = LIMIT) -> DataFrame:
    """``docs``, all columns, each text cut to its longest prefix of at most ``budget`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = counter(path).truncated
        for batch in sliced(batches):
            at = batch.schema.get_field_index("text")
            texts = [t if t is None else cut(t, budget) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.column(at).type))

    return docs.mapInArrow(run, docs.schema)
