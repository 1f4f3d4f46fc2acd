"""Benchmark decontamination: seeds of three words join texts to test items; Smith-Waterman scores the copies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import align as A
from barloom.llm import text as T

SCHEMA = "_id long, item_id long, score int, coverage double, matched int, start_word int, end_word int"


def item_words(texts: list[str | None]) -> list[np.ndarray]:
    out = []
    for s in T.slices(pa.array(texts, pa.string())):
        w, h = A.plain_words(s)
        out += [h[w.row_start[r] : w.row_start[r + 1]] for r in range(s.last - s.first)]
    return out


def grams(words: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, item, position) of every n-gram of the items."""
    parts = [T.window_hash(h, width) for h in words]
    n = [len(p) for p in parts]
    keys = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    return keys, np.repeat(np.arange(len(words)), n), np.concatenate([np.arange(k) for k in n]) if n else np.empty(0, np.int64)


# Word offsets of seeds. Items hold the first three, texts are looked up with all of them, and any
# shape of one side meets any shape of the other.
ITEM_SHAPES = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
TEXT_SHAPES = (*ITEM_SHAPES, (0, 2, 4), (0, 1, 4), (0, 3, 4))


def triples(h: np.ndarray, at: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Hash of the words at the offsets of the shape from each start."""
    out = h[at + shape[0]]
    for k in shape[1:]:
        out = out * T.P1 + h[at + k]
    return T.mix(out)


def seeds(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, item, position) of every item triple of every shape, however common."""
    keys, owner, place = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for shape in ITEM_SHAPES:
        for i, h in enumerate(words):
            at = np.arange(max(0, len(h) - shape[-1]))
            keys.append(triples(h, at, shape))
            owner.append(np.full(len(at), i))
            place.append(at)
    return np.concatenate(keys), np.concatenate(owner), np.concatenate(place)


class Bags:
    """The words of each item with their counts: at most so many can match in a stretch of text."""

    def __init__(self, words: list[np.ndarray]):
        bags = [np.unique(h, return_counts=True) for h in words]
        self.size = np.array([len(u) for u, _ in bags], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.count = np.concatenate([np.empty(0, np.int64), *[c for _, c in bags]])
        owner = np.repeat(np.arange(len(words)), self.size)
        keys = self.key(np.concatenate([np.empty(0, np.uint64), *[u for u, _ in bags]]), owner)
        self.index = A.Index([], 1, keys, owner, np.arange(len(keys)) - self.first[owner])

    @staticmethod
    def key(word: np.ndarray, owner: np.ndarray) -> np.ndarray:
        return T.mix(word * T.P1 + owner.astype(np.uint64))

    def bound(self, h: np.ndarray, owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Per stretch the words it has in common with its item, each as often as both hold it."""
        out = np.zeros(len(owner), np.int64)
        upto = np.cumsum(end - start)
        lo = 0
        while lo < len(owner):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + (1 << 20), "right")))
            o, s, n = owner[lo:hi], start[lo:hi], (end - start)[lo:hi]
            k = np.repeat(np.arange(len(o)), n)
            at = np.arange(len(k)) + np.repeat(s - (np.cumsum(n) - n), n)
            hit, slot = self.index.hits(self.key(h[at], o[k]))
            base = np.cumsum(self.size[o]) - self.size[o]
            total = int(self.size[o].sum())
            here = np.bincount(base[k[hit]] + self.index.place[slot], minlength=total)
            most = self.count[np.arange(total) + np.repeat(self.first[o] - base, self.size[o])]
            out[lo:hi] = np.add.reduceat(np.minimum(here, most), base)
            lo = hi
        return out


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    threshold: float = 0.5,
    least: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    block: int = 2000,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(id, item_id, score, coverage, matched, start_word, end_word): best alignment of each text and item.

    Words are runs of letters and digits in lower case. A pair is reported if its alignment reaches
    `threshold` of the item's full score and `least` matched words (all words of a shorter item).
    Seeds are three words matched in a row with at most one word lost, or two put in, between them;
    all are used, rare or common. For `threshold` 0.5 and `least` 7 or more, every pair that is to be
    reported has one if 7 words match: with w = item words lost + errors in a gap between matches, a
    score of half the full one needs sum(w) <= matches, but neighbouring gaps without a seed have
    w >= 3 together, which is more from 7 matches on. Shorter items (and lower thresholds) can miss
    copies with several words put in at more than one place.
    Items shorter than three words, null or empty, and null texts match nothing; null ids of texts
    are reported with a null id. Repeated texts are reported each, repeated items too. Long texts are
    searched whole. An empty table on either side gives an empty result. Columns of the texts named in `keep`
    come along (they must not be named as those above); others are not read.

    The benchmark is a stated query set: it goes out in blocks of about `block` items, each block
    against all texts, so what a task holds is bounded by a parameter and not by the benchmark.
    Texts are not shuffled; seeds, alignment and the choice of the best happen where a text is read.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), *keep)
    schema = ", ".join([SCHEMA, *(f"{c} {d.schema[c].dataType.simpleString()}" for c in keep)])
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).alias("t")).where("t is not null")
    size = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("c")).first()
    blocks = max(1, -(-size.n // block), -(-size.c // (1 << 22)))
    found = []
    for k in range(blocks if size.n else 0):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).orderBy("i", "t").toPandas()
        ids, words = part["i"].to_numpy(), item_words(part["t"].to_list())
        keys, owner, place = seeds(words)
        if not len(keys):
            continue
        index = A.Index(words, 3, keys, owner, place)
        found.append(d.mapInArrow(_search(index, ids, threshold, least, keep), schema))
    if not found:
        return spark.createDataFrame([], schema).withColumnRenamed("_id", id_col)
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out.withColumnRenamed("_id", id_col)


def _search(index: A.Index, ids: np.ndarray, threshold: float, least: int, keep: tuple[str, ...] = ()):
    size = np.array([len(w) for w in index.words], np.int64)
    need = np.maximum(np.ceil(threshold * size - 1e-9), np.minimum(least, size))
    bags = Bags(index.words)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in T.slices(b.column(1)):
                w, h = A.plain_words(s)
                at, seed = [], []
                for shape in TEXT_SHAPES:
                    begin = T.window_rows(w, shape[-1] + 1)
                    hit, found = index.hits(triples(h, begin, shape))
                    at.append(begin[hit])
                    seed.append(found)
                # An alignment of half the full score or more shifts by the item's length at most.
                found = A.candidates(index, w, np.concatenate(at), np.concatenate(seed), 1.0)
                few = bags.bound(h, found[1], found[2], found[3]) < need[found[1]]
                row, owner, start, end, lo, hi = (x[~few] for x in found)
                got = A.align_all(index, h, owner, start, end, lo, hi, None)
                full = size[owner]
                ok = (got.score >= threshold * A.MATCH * full) & (got.matches >= np.minimum(least, full))
                k = np.flatnonzero(ok)
                k = k[np.lexsort((got.b_start[k], -got.score[k], owner[k], row[k]))]
                new = np.ones(len(k), bool)
                new[1:] = (row[k][1:] != row[k][:-1]) | (owner[k][1:] != owner[k][:-1])
                k = k[new]
                first, at = w.row_start[row[k]], pa.array(row[k] + s.first)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(at),
                        pa.array(ids[owner[k]], pa.int64(), from_pandas=True),
                        pa.array(got.score[k].astype(np.int32)),
                        pa.array(got.matches[k] / full[k]),
                        pa.array(got.matches[k].astype(np.int32)),
                        pa.array((got.b_start[k] - first).astype(np.int32)),
                        pa.array((got.b_end[k] - first).astype(np.int32)),
                        *(b.column(2 + c).take(at) for c in range(len(keep))),
                    ],
                    ["_id", "item_id", "score", "coverage", "matched", "start_word", "end_word", *keep],
                )

    return search
