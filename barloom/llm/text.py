"""Vectorised text work inside tasks: words, hashes and n-grams of whole Arrow batches.

A batch of texts is one buffer of UTF-8 bytes with offsets, so words are found and hashed for many
texts by a few array operations. Buffers are cut at text borders into slices of about `SLICE` bytes;
a text longer than that is a slice of its own, and is never shortened.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
P1, P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)  # odd, so invertible mod 2^64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads every input bit over all output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


@dataclass
class Slice:
    """Some texts of a batch: rows first..last-1, their bytes, and where each starts in them."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


@dataclass
class Words:
    """Words of a slice in order: byte spans, the row each belongs to and its first word's index."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    row_start: np.ndarray  # per row, with one more entry at the end


def slices(column: pa.Array, size: int = SLICE) -> Iterator[Slice]:
    """Cut a string column at text borders. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, off, buf = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.empty(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(n, max(last, first + 1))
        yield Slice(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of true bytes that do not cross a text border."""
    n = len(inside)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    start = np.flatnonzero(inside & (~before | border[:-1]))
    end = np.flatnonzero(inside & (~after | border[1:])) + 1
    return start, end


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))


def words(s: Slice) -> Words:
    """Runs of bytes other than space and \\x09-\\x0D."""
    return as_words(s, *spans(~is_space(s.data), s.offsets))


def as_words(s: Slice, start: np.ndarray, end: np.ndarray) -> Words:
    row_start = np.searchsorted(start, s.offsets)
    row = np.repeat(np.arange(len(s.offsets) - 1), np.diff(row_start))
    return Words(start, end, row, row_start)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


class ByteSums:
    """Running polynomial sums over bytes, from which the hash of any span takes constant time."""

    def __init__(self, data: np.ndarray, base: np.uint64 = P1):
        self.total = np.empty(len(data) + 1, np.uint64)
        self.total[0] = 0
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(base, len(data)), out=self.total[1:])
        self.back = powers(inverse(base), len(data) + 1)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hash of each byte span: a polynomial over its bytes, then mixed."""
        poly = (self.total[end] - self.total[start]) * self.back[start]
        return mix(poly + (end - start).astype(np.uint64) * P2)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.uint64 = P1) -> np.ndarray:
    return ByteSums(data, base).hash(start, end)


def double(h: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """Hashes of runs of 2*width items from hashes of runs of `width`: H(s) * base^width + H(s+width)."""
    if len(h) <= width:
        return np.empty(0, np.uint64)
    return h[:-width] * np.uint64(pow(int(base), width, 1 << 64)) + h[width:]


def window_hash(h: np.ndarray, width: int, base: np.uint64 = P1) -> np.ndarray:
    """Hash of every run of `width` items (starting at index 0, 1, ...), built by Horner steps."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    for k in range(1, width):
        out = out * base + h[k : n + k]
    return mix(out)


def window_rows(w: Words, width: int) -> np.ndarray:
    """Starts of the windows of `width` words that lie in one text."""
    n = len(w.start) - width + 1
    return np.flatnonzero(w.row[: max(n, 0)] == w.row[width - 1 :]) if n > 0 else np.empty(0, np.int64)


def shingles(s: Slice, width: int, fold_case: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, word count per row): all shingles of `width` words; a shorter text is one shingle of all its words."""
    data = lower(s.data) if fold_case else s.data
    w = words(s)
    h = span_hash(data, w.start, w.end)
    at = window_rows(w, width)
    hashes, rows = window_hash(h, width)[at], w.row[at]
    n = np.diff(w.row_start)
    for r in np.flatnonzero((n > 0) & (n < width)):
        part = h[w.row_start[r] : w.row_start[r + 1]]
        hashes = np.append(hashes, window_hash(part, len(part)))
        rows = np.append(rows, r)
    return rows, hashes, n


def unique_pairs(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash) pairs in order of row and hash."""
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[new], hashes[new]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
