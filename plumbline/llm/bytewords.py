"""Words of Arrow text buffers by a byte automaton, many at a time.

The bytes of a column's UTF-8 buffer are classified by one lookup table; the bounds of words are where
neighbouring classes differ.  Only ASCII bytes divide words, so no character is ever cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD, GAP, BREAK = 0, 1, 2
#: Bytes of text that are taken apart at once; a longer text is taken whole.
SLICE = 2 << 20
#: Words of more bytes than this are few; the library's CRC takes them one at a time.
LONG_WORD = 256

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def byte_classes(gaps: bytes, breaks: bytes = b"") -> np.ndarray:
    """The class of each byte: ``gaps`` stand between words, ``breaks`` also end a piece of text."""
    table = np.full(256, WORD, np.uint8)
    table[list(gaps)] = GAP
    table[list(breaks)] = BREAK
    return table


#: Gaps of ASCII white space, and of everything in ASCII but letters and digits.
WHITE = byte_classes(b"\x20\t\n\x0b\x0c\r")
LETTERS_DIGITS = byte_classes(bytes(b for b in range(128) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123)))


class Words(NamedTuple):
    """``data[start:end]`` is a word, in lower case (A-Z); one space stands behind each, so a run of words
    is one range too.  ``row`` and ``piece`` (numbered over all rows) say where it came from."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    piece: np.ndarray
    rows: int

    def counts(self) -> np.ndarray:
        """Words of each row."""
        return np.bincount(self.row, minlength=self.rows)


def closed(text: Column) -> Column:
    """A text as :func:`slices` takes it: null is empty, and a line end stands behind it."""
    return F.concat(F.coalesce(text, F.lit("")), F.lit("\n"))


def words(texts: pa.Array, classes: np.ndarray) -> Words:
    """Words of a string array whose texts end in a byte that is no word's (:func:`closed`)."""
    _, offsets, data = texts.buffers()
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(offsets, wide, len(texts) + 1, texts.offset * np.dtype(wide).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8, at[-1] - at[0], at[0]) if len(texts) and at[-1] > at[0] else np.empty(0, np.uint8)
    at -= at[0]
    kind = classes[raw]
    inside = kind == WORD
    change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        change = np.r_[0, change]
    # a text ends in a gap, so bounds come in pairs
    first, behind = change[::2], change[1::2]
    inside[behind] = True
    low = LOWER[raw]
    low[behind] = 32
    end = np.cumsum(behind - first + 1) - 1
    row = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(first, at)))
    piece = np.cumsum(kind == BREAK)[first] if (classes == BREAK).any() else row
    return Words(low[inside], end - (behind - first), end, row, piece, len(texts))


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Runs of rows of ``batch`` with at most ``most`` bytes in ``column``, or one row each."""
    offsets = np.frombuffer(batch[column].buffers()[1], np.int32, len(batch) + 1, batch[column].offset * 4).astype(np.int64)
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def as_array(w: Words, start: np.ndarray | None = None, end: np.ndarray | None = None, kind: pa.DataType = pa.binary()) -> pa.Array:
    """The words, or the ranges of ``start`` and ``end``, as an Arrow array."""
    start, end = (w.start, w.end) if start is None else (start, end)
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=offsets[1:])
    take = np.repeat(start - offsets[:-1], end - start) + np.arange(offsets[-1])
    return pa.Array.from_buffers(kind, len(start), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(w.data[take])])


def as_bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(data, start, end) of a string array."""
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, np.int32, len(strings) + 1, strings.offset * 4).astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), at[:-1], at[1:]


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> np.uint32(1)), c >> np.uint32(1))
    return c


CRC_TABLE = _crc_table()


def crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The CRC-32 of every range, all advanced by one byte at a time from their starts on."""
    length = end - start
    out = np.empty(len(start), np.uint32)
    long = length > LONG_WORD
    for i in np.flatnonzero(long).tolist():
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes())
    short = np.flatnonzero(~long)
    # the longest first: those that go on are the first so many
    order = short[np.argsort(LONG_WORD - length[short].astype(np.int16), kind="stable")]
    longer = np.cumsum(np.bincount(length[short], minlength=LONG_WORD + 1)[::-1])[::-1]
    state, at = np.full(len(order), 0xFFFFFFFF, np.uint32), start[order]
    for j in range(LONG_WORD):
        n = int(longer[j + 1])
        if not n:
            break
        s = state[:n]
        state[:n] = CRC_TABLE[(s ^ data[at[:n] + j]) & np.uint32(255)] ^ (s >> np.uint32(8))
    out[order] = ~state
    return out
