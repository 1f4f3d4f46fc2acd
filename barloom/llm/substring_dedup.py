"""Substring dedup by level-wise doubling: words inside repeated windows are removed, first occurrences stay."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import text as T
from barloom.session import materialize


class Runs:
    """Hashes of word runs of any length in constant time: two sums of different bases over word hashes."""

    def __init__(self, s: T.Slice):
        self.words = T.words(s)
        h = T.span_hash(s.data, self.words.start, self.words.end)
        n = len(h) + 1
        self.sums, self.back = [], []
        for base, key in ((T.P1, h), (T.P2, T.mix(h + T.P1))):
            total = np.zeros(n, np.uint64)
            np.cumsum(key * T.powers(base, n - 1), out=total[1:])
            self.sums.append(total)
            self.back.append(T.powers(T.inverse(base), n))

    def hash(self, start: np.ndarray, width: np.ndarray | int, which: int = 0) -> np.ndarray:
        total, back = self.sums[which], self.back[which]
        poly = (total[start + width] - total[start]) * back[start]
        return T.mix(poly + np.asarray(width).astype(np.uint64) * T.P2)


def segments(r: Runs, width: int, seed: int) -> tuple[np.ndarray, ...]:
    """Runs of window starts with one anchor: (row, first start, number of windows, anchor start, anchor hash).

    A window's anchor is the run of `seed` words in it with the least hash (the first of equals), so
    equal windows have equal anchors at equal offsets.
    """
    start = T.window_rows(r.words, width)
    if not len(start):
        e = np.empty(0, np.int64)
        return e, e, e, e, e.view(np.uint64)
    n = len(r.words.start) - seed + 1
    g = r.hash(np.arange(n), seed)
    # Least over windows of `span` seed runs, by doubling the reach of a running minimum.
    span, reach = width - seed + 1, 1
    best = np.arange(n)
    while reach < span:
        step = min(reach, span - reach)
        other = best[np.minimum(np.arange(n) + step, n - 1)]
        take = g[other] < g[best]
        best = np.where(take, other, best)
        reach += step
    anchor = best[start]
    row = r.words.row[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    return row[first], start[first], count, anchor[first], g[anchor[first]]


def covered(n_words: int, starts: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
    """Mask of the words that windows starting at starts..starts+counts-1 cover."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + counts + width - 1, -1)
    return np.cumsum(edge[:-1]) > 0


SEED_WORDS = 5
SEGMENT = "h long, k long, doc long, start int, n int"


def _batch(*columns, names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [x.split()[0] for x in names.split(", ")])


def _segments(width: int, seed: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in T.slices(b.column(1)):
                r = Runs(s)
                row, start, n, _, h = segments(r, width, seed)
                k = r.hash(start, n + width - 1, 1)
                # Of equal segments of one document only the first goes out; the rest is found again at the end.
                first = _first_of_row(row, h, k)
                row, start, n, h, k = row[first], start[first], n[first], h[first], k[first]
                doc = b.column(0).take(pa.array(row + s.first))
                yield _batch(T.signed(h), T.signed(k), doc, (start - r.words.row_start[row]).astype(np.int32), n.astype(np.int32), names=SEGMENT)

    return find


def _first_of_row(row: np.ndarray, h: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Sorted indices of the first of equal (row, h, k)."""
    order = np.lexsort((np.arange(len(row)), k, h, row))
    new = np.ones(len(order), bool)
    a, b = order[1:], order[:-1]
    new[1:] = (row[a] != row[b]) | (h[a] != h[b]) | (k[a] != k[b])
    return np.sort(order[new])


def _flat(lists: pa.Array, field: str) -> tuple[np.ndarray, np.ndarray]:
    """(row of each entry, the entries' field) of a list<struct> column; null lists are empty."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(lists)), size), lists.flatten().field(field).to_numpy(zero_copy_only=False).astype(np.int64)


HALF = "half long, doc long, start int, a array<long>, b array<long>"


def _halves(width: int, seed: int, level: int):
    """Windows of the listed segments, grouped by the run of `level` words around their anchor that they contain."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at_row, at_start = _flat(b.column(2), "start")
            for s in T.slices(b.column(1)):
                r = Runs(s)
                row, start, n, anchor, _ = segments(r, width, seed)
                lo, hi = np.searchsorted(at_row, [s.first, s.last])
                wanted = r.words.row_start[at_row[lo:hi] - s.first] + at_start[lo:hi]
                pick = np.isin(start, wanted)
                row, start, n, anchor = row[pick], start[pick], n[pick], anchor[pick]
                # Windows that start early enough hold the run that ends with the anchor; the others the one that starts with it.
                left = np.clip(anchor - (level - seed) - start + 1, 0, n)
                run = np.concatenate([(anchor - (level - seed))[left > 0], anchor[left < n]])
                first = np.concatenate([start[left > 0], (start + left)[left < n]])
                count = np.concatenate([left[left > 0], (n - left)[left < n]])
                owner = np.concatenate([row[left > 0], row[left < n]])
                cut = np.concatenate([[0], np.cumsum(count)])
                each = np.arange(cut[-1]) - np.repeat(cut[:-1] - first, count)
                a, c = (pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(T.signed(r.hash(each, width, k)))) for k in (0, 1))
                doc = b.column(0).take(pa.array(owner + s.first))
                yield _batch(T.signed(r.hash(run, level)), doc, (first - r.words.row_start[owner]).astype(np.int32), a, c, names=HALF)

    return find


RESULT = "doc long, n_words long, n_removed long, kept_sha256 string, kept string"


def _keep(width: int, seed: int, with_text: bool):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (hit_row, hit_start), (_, hit_n) = _flat(b.column(2), "start"), _flat(b.column(2), "n")
            known = b.column(0).is_valid().to_numpy(zero_copy_only=False)
            for s in T.slices(b.column(1)):
                r = Runs(s)
                w, total = r.words, len(r.words.start)
                row, start, n, _, h = segments(r, width, seed)
                later = np.ones(len(row), bool)
                later[_first_of_row(row, h, r.hash(start, n + width - 1, 1))] = False
                later &= known[row + s.first]
                lo, hi = np.searchsorted(hit_row, [s.first, s.last])
                own = hit_row[lo:hi] - s.first
                end = w.row_start[own + 1]
                begin = np.minimum(w.row_start[own] + hit_start[lo:hi], end)
                stop = np.minimum(begin + hit_n[lo:hi] + width - 1, end)
                edge = np.zeros(total + 1, np.int64)
                np.add.at(edge, np.concatenate([begin, start[later]]), 1)
                np.add.at(edge, np.concatenate([stop, (start + n + width - 1)[later]]), -1)
                stay = np.cumsum(edge[:-1]) == 0
                size = (w.end - w.start)[stay] + 1
                out = np.concatenate([[0], np.cumsum(size)])
                source = np.arange(out[-1]) - np.repeat(out[:-1], size) + np.repeat(w.start[stay], size)
                data = s.data[np.minimum(source, len(s.data) - 1)].copy() if len(source) else np.empty(0, np.uint8)
                data[out[1:] - 1] = 0x20
                kept = np.concatenate([[0], np.cumsum(stay)])[w.row_start]
                raw, byte = data.tobytes(), out[kept]
                texts = [raw[byte[k] : max(byte[k], byte[k + 1] - 1)] for k in range(len(byte) - 1)]
                yield _batch(
                    b.column(0).slice(s.first, s.last - s.first),
                    np.diff(w.row_start),
                    np.diff(w.row_start) - np.diff(kept),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                    pa.array([t.decode() for t in texts] if with_text else [None] * len(texts), pa.string()),
                    names=RESULT,
                )

    return keep


def dedup_substrings(
    docs: DataFrame, width: int = 20, seed: int = SEED_WORDS, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True
) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, kept) per input row: words outside repeated windows.

    Words are runs of bytes other than space and \\x09-\\x0D. A window is `width` words in a row of
    one text; a word goes if a window over it has the same words as one that starts earlier (smaller
    id, or same id and earlier start), judged on the input. `width` is `seed` doubled some times.

    Level by level: windows with the same least run of `seed` words (their anchor) form segments.
    Segments whose anchor stands in no other segment are done. Of the rest, equal segments are
    settled whole, so a passage with any number of copies leaves one. Only anchors with differing
    segments go on: the run is doubled, and runs that stand once are done, until the length is
    `width` and single windows are compared. Hashes of 128 bits stand for the words.

    Null and empty texts have no words. Rows with a null id are returned whole and remove nothing.
    Rows of one id do not remove from each other (an id names one text; positions of rows of one id
    with unlike texts are merged). An empty table gives an empty result. `kept` is null without
    `with_text`. Other columns of the input are not read.
    """
    levels = [seed]
    while levels[-1] < width:
        levels.append(levels[-1] * 2)
    if levels[-1] != width or len(levels) < 2:
        raise ValueError("width must be seed doubled at least once")
    d = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    named = d.where("_id is not null")
    all_segments = named.mapInArrow(_segments(width, seed), SEGMENT)
    anchors = all_segments.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("k").alias("lo"), F.max("k").alias("hi"))
    anchors = anchors.where("c > 1").select("h", (F.col("lo") != F.col("hi")).alias("differ"))
    alive = materialize(all_segments.join(anchors, "h"), "segments")
    first = alive.groupBy("h", "k").agg(F.min("doc").alias("first"))
    settled = materialize(
        alive.join(first, ["h", "k"]).select("doc", "start", "n", "differ", (F.col("doc") > F.col("first")).alias("again")).where("again or differ"),
        "settled",
    )
    hits = settled.where("again").select("doc", "start", "n")
    open_ = settled.where("not again").groupBy("doc").agg(F.collect_list(F.struct("start")).alias("_open"))
    runs = named.join(open_, F.col("_id") == F.col("doc")).select("_id", "_text", "_open")
    rows = materialize(runs.mapInArrow(_halves(width, seed, levels[1]), HALF), "doubled")
    several = rows.groupBy("half").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("half")
    alive = rows.join(several, "half", "left_semi")
    windows = alive.select("doc", F.posexplode(F.arrays_zip("a", "b")).alias("i", "w"), "start")
    windows = windows.select("doc", (F.col("start") + F.col("i")).alias("start"), F.col("w.a").alias("a"), F.col("w.b").alias("b"))
    windows = materialize(windows, "windows")
    least = windows.groupBy("a", "b").agg(F.min(F.struct("doc", "start")).alias("f"), F.count(F.lit(1)).alias("c")).where("c > 1")
    late = windows.join(least, ["a", "b"]).where(F.struct("doc", "start") > F.col("f"))
    hits = hits.union(late.select("doc", "start", F.lit(1).alias("n")))
    hits = hits.groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("_hits"))
    out = d.join(hits, F.col("_id") == F.col("doc"), "left").select("_id", "_text", "_hits")
    return out.mapInArrow(_keep(width, seed, with_text), RESULT).withColumnRenamed("doc", id_col)
