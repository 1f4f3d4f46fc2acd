"""Seeded local alignment of word sequences, batched: many short alignments advance together."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from barloom.llm import text as T

MATCH, MISMATCH, GAP = 2, -1, -1


@dataclass
class Aligned:
    """Best local alignment per candidate; positions are word indices, ends exclusive."""

    score: np.ndarray
    matches: np.ndarray
    a_start: np.ndarray
    a_end: np.ndarray
    b_start: np.ndarray
    b_end: np.ndarray


def smith_waterman(a: np.ndarray, b: np.ndarray, a_len: np.ndarray, b_len: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None) -> Aligned:
    """Align rows of `a` with rows of `b` (padded word hashes), by anti-diagonals of all rows at once.

    With `low` and `high`, only cells with low <= j - i <= high are filled (a band). Each cell
    carries where its alignment began and its matches, so no matrix is kept.
    """
    n, m = a.shape
    width = b.shape[1]
    i = np.arange(m)
    zero = lambda: np.zeros((n, m + 1), np.int32)  # noqa: E731  column 0 stands for i = -1
    # State of the last two diagonals: score, matches, start in a, start in b.
    h1, h2 = [zero() for _ in range(4)], [zero() for _ in range(4)]
    best = [np.zeros(n, np.int32) for _ in range(6)]
    for d in range(m + width - 1):
        j = d - i
        ok = (j >= 0) & (j < width)
        valid = ok[None, :] & (i[None, :] < a_len[:, None]) & (j[None, :] < b_len[:, None])
        if low is not None:
            valid &= ((j - i)[None, :] >= low[:, None]) & ((j - i)[None, :] <= high[:, None])
        same = (a == b[:, np.clip(j, 0, width - 1)]) & valid
        diag, up, left = h2[0][:, :-1], h1[0][:, :-1] + GAP, h1[0][:, 1:] + GAP
        cross = diag + np.where(same, MATCH, MISMATCH)
        score = np.maximum(np.maximum(cross, up), np.maximum(left, 0))
        score[~valid] = 0
        by_cross, by_up = score == cross, score == up
        fresh = by_cross & (diag == 0)
        new = [zero() for _ in range(4)]
        new[0][:, 1:] = score
        for k in (1, 2, 3):
            new[k][:, 1:] = np.where(by_cross, h2[k][:, :-1], np.where(by_up, h1[k][:, :-1], h1[k][:, 1:]))
        new[1][:, 1:] = np.where(fresh, 0, new[1][:, 1:]) + (by_cross & same)
        new[2][:, 1:] = np.where(fresh, i[None, :], new[2][:, 1:])
        new[3][:, 1:] = np.where(fresh, j[None, :], new[3][:, 1:])
        at = score.argmax(1)
        rows = np.arange(n)
        top = score[rows, at]
        better = top > best[0]
        if better.any():
            for k, x in enumerate((top, new[1][rows, at + 1], new[2][rows, at + 1], at + 1, new[3][rows, at + 1], d - at + 1)):
                best[k][better] = x[better]
        h1, h2 = new, h1
    return Aligned(*best)


def letters(data: np.ndarray) -> np.ndarray:
    """Bytes of words for alignment: letters, digits, and whatever is not ASCII."""
    return ((data >= 65) & (data <= 90)) | ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57)) | (data >= 128)


def plain_words(s: T.Slice) -> tuple[T.Words, np.ndarray]:
    """Runs of letters and digits, hashed in lower case, so that signs and case do not matter."""
    w = T.as_words(s, *T.spans(letters(s.data), s.offsets))
    return w, T.span_hash(T.lower(s.data), w.start, w.end)


@dataclass
class Index:
    """Seeds of known sequences: sorted hashes with the sequence and position of each."""

    words: list[np.ndarray]
    width: int
    keys: np.ndarray
    owner: np.ndarray
    place: np.ndarray

    def __post_init__(self) -> None:
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.owner, self.place = self.keys[order], self.owner[order], self.place[order]
        self.filter = np.zeros(1 << 22, bool)  # most windows of a text miss; this spares their search
        self.filter[(self.keys & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def hits(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into keys, index of seed) of all matches."""
        may = np.flatnonzero(self.filter[(keys & np.uint64((1 << 22) - 1)).astype(np.int64)])
        lo = np.searchsorted(self.keys, keys[may], "left")
        n = np.searchsorted(self.keys, keys[may], "right") - lo
        at = np.repeat(may, n)
        seed = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else lo
        return at, seed


def candidates(index: Index, w: T.Words, at: np.ndarray, seed: np.ndarray, slack: float) -> tuple[np.ndarray, ...]:
    """Stretches of text around seeds of one sequence: (row, sequence, first word, end word, least and greatest diagonal).

    Seeds of a text and sequence whose diagonals lie closer than the slack are one stretch.
    """
    row, owner, diagonal = w.row[at], index.owner[seed], at - index.place[seed]
    order = np.lexsort((diagonal, owner, row))
    row, owner, diagonal = row[order], owner[order], diagonal[order]
    size = np.array([len(x) for x in index.words], np.int64)
    room = np.maximum(4, (size * slack).astype(np.int64))
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (owner[1:] != owner[:-1]) | (diagonal[1:] - diagonal[:-1] > room[owner[1:]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1 if len(first) else first
    row, owner, lo, hi = row[first], owner[first], diagonal[first], diagonal[last]
    start = np.maximum(w.row_start[row], lo - room[owner])
    end = np.minimum(w.row_start[row + 1], hi + size[owner] + room[owner])
    return row, owner, start, end, lo, hi


def align_all(index: Index, hashes: np.ndarray, owner: np.ndarray, start: np.ndarray, end: np.ndarray, lo: np.ndarray, hi: np.ndarray, band: int | None) -> Aligned:
    """Align every stretch with its sequence, in batches of like size with bounded arrays."""
    n = len(owner)
    out = Aligned(*(np.zeros(n, np.int64) for _ in range(6)))
    size = np.array([len(x) for x in index.words], np.int64)
    todo = np.lexsort((end - start, size[owner])) if n else np.empty(0, np.int64)
    k = 0
    while k < n:
        m = size[owner[todo[k]]]
        room = max(1, (1 << 19) // int(max(end[todo[k]] - start[todo[k]], m) * 4))
        part = todo[k : k + room]
        k += len(part)
        a_len, b_len = size[owner[part]], end[part] - start[part]
        a, b = np.zeros((len(part), a_len.max()), np.uint64), np.zeros((len(part), b_len.max()), np.uint64)
        for r, p in enumerate(part):
            a[r, : a_len[r]] = index.words[owner[p]]
            b[r, : b_len[r]] = hashes[start[p] : end[p]]
        limits = (lo[part] - start[part] - band, hi[part] - start[part] + band) if band is not None else (None, None)
        got = smith_waterman(a, b, a_len, b_len, *limits)
        for name in ("score", "matches", "a_start", "a_end"):
            getattr(out, name)[part] = getattr(got, name)
        out.b_start[part], out.b_end[part] = got.b_start + start[part], got.b_end + start[part]
    return out


def char_offsets(data: np.ndarray) -> np.ndarray:
    """Characters before each byte of a UTF-8 buffer."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
