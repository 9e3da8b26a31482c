"""Words of whole text columns, cut and numbered by Arrow for many texts at a time.

A batch's text buffer is translated once as bytes (every separator to a space, A-Z to lower
case where asked), split at spaces and dictionary-encoded, so that no text becomes a Python
object. Work goes on in steps of about ``STEP`` bytes whatever the number or the length of the
texts; a text above that is cut at spaces and goes through in several pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

STEP = 4_000_000

#: Letters of ASCII in lower case, digits and bytes above 0x7F are word bytes, all others separate.
ALNUM = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()
#: ASCII white space separates, all else is kept.
SPACES = bytes(32 if b in b"\t\n\v\f\r" else b for b in range(256))


@dataclass
class Piece:
    """Texts, or a part of one: ``first`` is the row of the first; ``more`` says that another
    part of the (only) text follows; its first ``carried`` words were in the part before."""

    texts: pa.Array
    first: int
    more: bool = False
    carried: int = 0


@dataclass
class Numbered:
    """Words of a piece in order: their numbers in ``dictionary``, and which text each is of."""

    codes: np.ndarray
    text: np.ndarray
    dictionary: pa.Array


def _texts(raw: bytes, offsets: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(
        len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, "<i8")), pa.py_buffer(raw))


def pieces(column: pa.Array, table: bytes | None, step: int = STEP, carry: int = 0,
           cut: re.Pattern = re.compile(b" ")) -> Iterator[Piece]:
    """The texts of ``column`` (null: empty), translated by ``table``, in steps. A long text is cut
    where ``cut`` is found; ``carry`` words are repeated at the head of each further part."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], "<i8", n + 1, column.offset * 8)
    data = column.buffers()[2]
    lo = 0
    while lo < n:
        start, hi = int(offsets[lo]), int(np.searchsorted(offsets, offsets[lo] + step, "right")) - 1
        if hi > lo:
            hi = min(hi, n)
            raw = data[start:int(offsets[hi])].to_pybytes() if data else b""
            raw = raw.translate(table) if table else raw
            yield Piece(_texts(raw, offsets[lo:hi + 1] - start), lo)
            lo = hi
            continue
        raw = data[start:int(offsets[lo + 1])].to_pybytes()
        raw = raw.translate(table) if table else raw
        at, held = 0, []
        while at < len(raw):
            found = cut.search(raw, at + step) if len(raw) - at > step else None
            end = found.start() if found else len(raw)
            part = b" ".join([*held, raw[at:end]])
            yield Piece(_texts(part, np.array([0, len(part)])), lo, end < len(raw), len(held))
            if carry:
                held = (held + raw[at:end].split())[-carry:]
            at = end
        lo += 1


def numbered(texts: pa.Array) -> Numbered:
    lists = pc.ascii_split_whitespace(texts)
    sizes = np.diff(lists.offsets.to_numpy())
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy()
    text = np.repeat(np.arange(len(texts)), sizes)
    blank = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    if blank >= 0:
        kept = codes != blank
        codes, text = codes[kept], text[kept]
    return Numbered(codes, text, coded.dictionary)
