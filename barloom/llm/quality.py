"""Quality classifier: ordinal cumulative-link regression on hashed text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm import text as T
from barloom.session import materialize

BITS = 18  # 2^18 weights: a bounded model, shipped with the tasks


PREFIXES = (4, 6)  # bytes of a word's beginning, for words of one stem


def features(s: T.Slice, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) pairs: words in lower case, their beginnings, runs of signs, and binned ratios of the text."""
    n, mask = len(s.offsets) - 1, np.uint64((1 << bits) - 1)
    d = s.data
    upper = (d >= 65) & (d <= 90)
    letter = upper | ((d >= 97) & (d <= 122)) | ((d >= 48) & (d <= 57)) | (d >= 128)
    sign = ~letter & ~T.is_space(d)
    low = T.lower(d)
    word, mark = (T.as_words(s, *T.spans(x, s.offsets)) for x in (letter, sign))

    def cells(rows: np.ndarray, keys: np.ndarray) -> np.ndarray:
        return (rows.astype(np.uint64) << np.uint64(bits)) | (keys & mask)

    total = T.ByteSums(low)
    own = np.unique(cells(word.row, total.hash(word.start, word.end)))
    found = [own, cells(mark.row, T.mix(total.hash(mark.start, mark.end) + np.uint64(1)))]
    for k in PREFIXES:
        long = np.flatnonzero(word.end - word.start > k)
        start = word.start[long]
        found.append(cells(word.row[long], T.mix(total.hash(start, start + k) + np.uint64(k))))
    size = np.maximum(np.diff(s.offsets), 1)
    per = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[s.offsets])
    words = np.maximum(np.diff(word.row_start), 1)
    distinct = np.bincount((own >> np.uint64(bits)).astype(np.int64), minlength=n)
    ratios = (per(upper) / size, per(sign) / size, np.diff(mark.row_start) / words, per(letter) / words / 12,
              distinct / words, np.log2(words + 1) / 16)
    for k, r in enumerate(ratios):
        bin_ = np.minimum((r * 20).astype(np.int64), 40) + 64 * (k + 1)
        found.append(cells(np.arange(n), T.mix(bin_.astype(np.uint64) + np.uint64(1 << 40))))
    all_cells = np.unique(np.concatenate(found))
    return (all_cells >> np.uint64(bits)).astype(np.int64), all_cells & mask


@dataclass(frozen=True)
class Ordinal:
    """P(grade > k) = sigmoid(w.x - threshold_k) with one weight vector and rising thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """Columns P(grade >= 1), P(grade >= 2), ..."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -60, 60)))


def telling(seen: np.ndarray, per_grade: np.ndarray, min_rows: int = 3, least: float = 20.0) -> np.ndarray:
    """Buckets that go with the grade: chi-square of presence (bucket, grade counts) against grade of `least` or more."""
    per, n = seen.sum(1), max(per_grade.sum(), 1)
    expect = per[:, None] * per_grade / n
    chi = ((seen - expect) ** 2 / np.maximum(expect, 1e-9)).sum(1) / np.maximum(1 - per / n, 1e-3)
    return np.flatnonzero((chi >= least) & (per >= min_rows))


def fit(row: np.ndarray, bucket: np.ndarray, grade: np.ndarray, grades: int, bits: int, l2: float = 0.005, steps: int = 400) -> Ordinal:
    """Maximum likelihood with a ridge, by adaptive full-batch steps.

    Thresholds are a first one plus positive gaps (exponentials), so they stay ordered.
    """
    used, col = np.unique(bucket, return_inverse=True)
    n, v = len(grade), np.zeros(len(used))
    order = np.arange(grades)
    share = np.array([(grade >= k).mean() if n else 0.5 for k in order[1:]]).clip(0.01, 0.99)
    t = np.log((1 - share) / share)
    raw = np.concatenate([t[:1], np.log(np.maximum(np.diff(t), 0.05))])
    m, s = np.zeros(len(v) + len(raw)), np.zeros(len(v) + len(raw))
    for step in range(1, steps + 1):
        th = np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))
        z = np.bincount(row, v[col], n)
        up = np.concatenate([th, [np.inf]])[grade] - z  # P(y <= g) = sigmoid(th_g - z)
        lo = np.concatenate([[-np.inf], th])[grade] - z
        su, sl = 1 / (1 + np.exp(-np.clip(up, -60, 60))), 1 / (1 + np.exp(-np.clip(lo, -60, 60)))
        su, sl = np.where(np.isinf(up), 1, su), np.where(np.isinf(lo), 0, sl)
        p = np.maximum(su - sl, 1e-12)
        du, dl = su * (1 - su) / p, sl * (1 - sl) / p
        gz = du - dl  # d(-log p)/dz
        g_th = np.bincount(grade, -du, grades)[:-1] + np.bincount(grade, dl, grades)[1:]
        g_raw = np.concatenate([[g_th.sum()], np.exp(raw[1:]) * np.cumsum(g_th[::-1])[::-1][1:]])
        g = np.concatenate([np.bincount(col, gz[row], len(v)) + l2 * n / 100 * v, g_raw]) / max(n, 1)
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        d = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6) * min(1, 3 * (1 - step / (steps + 1)))
        v, raw = v - d[: len(v)], raw - d[len(v) :]
    w = np.zeros(1 << bits)
    w[used] = v
    return Ordinal(w, np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])])))


def train(docs: DataFrame, rated: DataFrame, grades: int, max_labelled: int = 12000, bits: int = BITS) -> Ordinal:
    """Fit on at most `max_labelled` rated documents (id, grade), the first by a hash of their id.

    That bound is the only sample. Rows with a null or unknown grade are left out; a repeated id
    counts by its lowest grade, and repeated rows of it each. Counts of bucket and grade are
    aggregated first, so that the driver gets no more than the buckets that go with the grade.
    """
    ok = rated.where(F.col("_grade").between(0, grades - 1) & F.col("_id").isNotNull())
    picked = ok.groupBy("_id").agg(F.min("_grade").alias("_grade")).orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)
    # At most max_labelled rows of two numbers, so the broadcast is bounded by a parameter.
    have = materialize(docs.join(F.broadcast(picked), "_id").select("_id", "_grade", "_text"), "rated")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << bits) * grades, np.int64)
        for b in batches:
            grade = b.column(1).to_numpy(zero_copy_only=False)
            for s in T.slices(b.column(2)):
                row, bucket = features(s, bits)
                total += np.bincount(bucket.astype(np.int64) * grades + grade[row + s.first], minlength=len(total))
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], ["k", "n"])

    got = have.mapInArrow(tally, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    seen = np.bincount(got["k"].to_numpy(), got["n"].to_numpy(), (1 << bits) * grades)
    per_grade = have.groupBy("_grade").count().toArrow()
    chosen = telling(seen.reshape(-1, grades), np.bincount(per_grade["_grade"].to_numpy(), per_grade["count"].to_numpy(), grades))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = np.zeros(1 << bits, bool)
        use[chosen] = True
        for b in batches:
            for s in T.slices(b.column(2)):
                row, bucket = features(s, bits)
                row, bucket = row[use[bucket]], bucket[use[bucket]]
                cut = np.searchsorted(row, np.arange(len(s.offsets)))
                part = b.slice(s.first, s.last - s.first)
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(bucket.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], ["_id", "_grade", "_f"])

    # Sorted, so that the fit does not depend on the order of tasks.
    found = have.mapInArrow(tokens, "_id long, _grade int, _f array<int>").orderBy("_id", F.size("_f")).toArrow()
    lists = found["_f"].combine_chunks()
    sizes, bucket = np.diff(lists.offsets.to_numpy()) if len(lists) else np.empty(0, np.int64), lists.flatten().to_numpy().astype(np.int64)
    return fit(np.repeat(np.arange(len(sizes)), sizes), bucket, found["_grade"].to_numpy().astype(np.int64), grades, bits)


def inputs(docs: DataFrame, rated: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    d = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return d, rated.select(F.col(id_col).cast("long").alias("_id"), F.col("grade").cast("int").alias("_grade"))


def tails_of(model: Ordinal, s: T.Slice) -> np.ndarray:
    row, bucket = features(s)
    return model.tails(np.bincount(row, model.weights[bucket], len(s.offsets) - 1))


def classify(docs: DataFrame, rated: DataFrame, grades: int = 3, keep_from: int = 2, keep_tail: float = 0.5,
             id_col: str = "doc_id", text_col: str = "text", max_labelled: int = 12000) -> DataFrame:
    """(id, expected_grade, tail_prob, grade, kept) per input row.

    `rated` has (id, `grade` from 0). `tail_prob` is P(grade >= keep_from); a document is kept from
    `keep_tail` on. `grade` is the most likely one. Null and empty texts are scored as texts without
    words; whole texts count. Null ids are scored too. Repeated rows are scored each, and an empty
    table gives an empty result. Without any usable rating every grade is about as likely as another.
    Other columns of the input are not read.
    """
    d, r = inputs(docs, rated, id_col, text_col)
    model = train(d, r, grades, max_labelled)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in T.slices(b.column(1)):
                tails = tails_of(model, s)
                each = -np.diff(np.concatenate([np.ones((len(tails), 1)), tails, np.zeros((len(tails), 1))], 1), axis=1)
                tail = tails[:, keep_from - 1]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(s.first, s.last - s.first), pa.array(tails.sum(1)), pa.array(tail),
                     pa.array(each.argmax(1).astype(np.int32)), pa.array(tail >= keep_tail)],
                    ["_id", "expected_grade", "tail_prob", "grade", "kept"],
                )

    out = d.mapInArrow(score, "_id long, expected_grade double, tail_prob double, grade int, kept boolean")
    return out.withColumnRenamed("_id", id_col)


def select_good(docs: DataFrame, rated: DataFrame, grades: int = 3, keep_from: int = 2, keep_tail: float = 0.5,
                id_col: str = "doc_id", text_col: str = "text", max_labelled: int = 12000) -> DataFrame:
    """The rows of `docs`, all columns, that `classify` keeps; decided where a row is read, without a join."""
    model = train(*inputs(docs, rated, id_col, text_col), grades, max_labelled)
    at = docs.columns.index(text_col)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [tails_of(model, s)[:, keep_from - 1] >= keep_tail for s in T.slices(b.column(at))]
            if kept:
                yield b.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(choose, docs.schema)


def grade_of(quality: Column, toxic: Column) -> Column:
    """0: poor, 1: well written but toxic, 2: well written and clean. Null where a part is unknown."""
    return F.when(quality == 0, 0).when((quality == 1) & (toxic == 1), 1).when((quality == 1) & (toxic == 0), 2)
