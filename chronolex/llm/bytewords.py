"""Words of whole Arrow columns at once: one table maps the bytes of all texts, and bounds are found by numpy.

Words here are runs of the bytes that a table keeps; every byte above 0x7F is kept, so a character of
several bytes is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text in one piece; a longer text is cut between words.
PIECE_BYTES = 1 << 21
SPACE = 0x20


def table(kept: bytes) -> bytes:
    """A byte map: A-Z to lower case, the kept bytes and all above 0x7F to themselves, others to a space."""
    out = bytearray(b" " * 128 + bytes(range(128, 256)))
    for b in kept:
        out[b] = b | 0x20 if 0x41 <= b <= 0x5A else b
    return bytes(out)


LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
DIGITS = b"0123456789"


def texts(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """The column's texts in one string of bytes, and where each starts (and the last ends); null is empty."""
    column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_string()).fill_null("")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    first = int(at[0]) if len(at) else 0
    return (data.slice(first, int(at[-1]) - first).to_pybytes() if data is not None and len(at) else b""), at - first


class Piece(NamedTuple):
    """Some whole texts, or a part of a long one."""

    #: The mapped bytes, and where they start in the column's bytes.
    data: bytes
    origin: int
    #: Bounds of the words in ``data``, and the row of each word.
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    #: So many words of the row stand before the first one here.
    before: int
    #: So many of the first words were in the row's piece before, too.
    shared: int


def pieces(data: bytes, at: np.ndarray, mapping: bytes, overlap: int = 0, size: int = PIECE_BYTES) -> Iterator[Piece]:
    """The words of ``texts``, piece by piece; a text of over ``size`` bytes is cut, its pieces sharing ``overlap`` words."""
    first = 0
    while first < len(at) - 1:
        last = max(int(np.searchsorted(at, at[first] + size, side="right")) - 1, first + 1)
        whole = data[at[first] : at[last]].translate(mapping)
        if last - first > 1 or len(whole) <= size:
            cuts = at[first:last] - at[first]
            starts, ends = _bounds(whole, cuts)
            yield Piece(whole, int(at[first]), starts, ends, first + np.searchsorted(cuts, starts, side="right") - 1, 0, 0)
        else:
            yield from _long(whole, int(at[first]), first, overlap, size)
        first = last


def _bounds(data: bytes, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than a space; no run goes on over a cut."""
    inside = np.concatenate([[False], np.frombuffer(data, np.uint8) != SPACE, [False]])
    begin, stop = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    joined = cuts[(cuts > 0) & (cuts < len(data))]
    joined = joined[inside[joined] & inside[joined + 1]]
    begin[joined] = stop[joined] = True
    return np.flatnonzero(begin), np.flatnonzero(stop)


def _long(data: bytes, origin: int, row: int, overlap: int, size: int) -> Iterator[Piece]:
    at = before = shared = 0
    while True:
        want = size
        while True:  # more words than the next piece takes over, or the text's end
            end = data.find(b" ", min(at + want, len(data)))
            end = len(data) if end < 0 else end
            starts, ends = _bounds(data[at:end], np.zeros(0, np.int64))
            if end == len(data) or len(starts) > overlap:
                break
            want *= 2
        yield Piece(data[at:end], origin + at, starts, ends, np.full(len(starts), row), before, shared)
        if end == len(data):
            return
        before += len(starts) - overlap
        at, shared = (at + int(starts[len(starts) - overlap]) if overlap else end), overlap
