"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, exact cosines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import acos, ceil, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm import blocks as B
from barloom.llm.components import components
from barloom.session import materialize


def learn_rotation(x: np.ndarray, seed: int, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(projection, thresholds): a rotation of the centred data that brings it near the corners of a cube.

    Alternates signs with the best rotation onto them. Each bit is then cut at its median, so that
    it is balanced. A sample smaller than its dimension gives a random rotation.
    """
    d = x.shape[1]
    r, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    if len(x) >= d:
        c = x - x.mean(0)
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(c.T @ np.sign(c @ r))
            r = u @ vt
        return r, np.median(x @ r, axis=0)
    return r, np.zeros(d)


BANK = 4096  # learned bits from which more tables than that draw theirs


@dataclass(frozen=True)
class Tables:
    """Codes of several learned rotations, in `tables` substrings of `bits` bits."""

    bits: int
    tables: int
    sample: np.ndarray  # rows of unit vectors, all of one dimension


class Coder:
    """The rotations of a dimension, learned once per task."""

    def __init__(self, t: Tables):
        self.t, self.known = t, {}
        need = t.bits * t.tables
        self.bank = min(need, max(BANK, t.bits))
        draw = np.random.default_rng(29)
        picks = [draw.choice(self.bank, t.bits, replace=False) for _ in range(t.tables)] if need > self.bank else [np.arange(need)]
        self.picks = np.concatenate(picks)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        d, t = x.shape[1], self.t
        if not t.bits:
            return np.zeros((len(x), t.tables), np.int64)
        if d not in self.known:
            own = t.sample if t.sample.shape[1] == d else np.empty((0, d))
            self.known[d] = learned(own, self.bank)
        r, cut = self.known[d]
        flat = (x @ r > cut)[:, self.picks].reshape(len(x), t.tables, t.bits)
        return flat @ (1 << np.arange(t.bits, dtype=np.int64))


def learned(sample: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Projections and thresholds of the first so many bits."""
    each = [learn_rotation(sample, k) for k in range(ceil(bits / sample.shape[1]))]
    return np.concatenate([r for r, _ in each], 1)[:, :bits], np.concatenate([c for _, c in each])[:bits]


def usable(v: Column) -> Column:
    """Neither null nor zero, all components finite."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length as unit vectors in double precision."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = x.reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row indices, unit vectors) of each vector length in a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        yield at, unit(column.take(pa.array(at)))


def turned(x: np.ndarray, threshold: float, seed: int) -> np.ndarray:
    """A partner of each row at the threshold (or as far as they go), spread about the common mean as the rows are."""
    mean = x.mean(0)
    c = x - mean
    z = np.random.default_rng(seed).permutation(c)
    own = np.linalg.norm(c, axis=1, keepdims=True)
    z = z - c * ((z * c).sum(1, keepdims=True) / np.maximum(own, 1e-12) ** 2)
    z *= own / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    lo, hi = np.zeros((len(x), 1)), np.full((len(x), 1), pi)
    y = x
    for _ in range(40):
        mid = (lo + hi) / 2
        y = mean + np.cos(mid) * c + np.sin(mid) * z
        y = y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
        near = (x * y).sum(1, keepdims=True) > threshold
        lo, hi = np.where(near, mid, lo), np.where(near, hi, mid)
    return y


def agreement(sample: np.ndarray, held: np.ndarray, threshold: float, bits: int = 512) -> np.ndarray:
    """Per held-out vector the share of learned bits in which it agrees with a partner at the threshold."""
    r, cut = learned(sample, bits)
    pairs = [(held @ r > cut) == (turned(held, threshold, k) @ r > cut) for k in range(2)]
    return np.concatenate([p.mean(1) for p in pairs])


def plan(n: int, threshold: float, recall: float, sample: np.ndarray, held: np.ndarray, other: bool = False) -> Tables:
    """Substring length and number of tables for n vectors.

    Bits are learned on centred data, so how often one separates a pair at the threshold depends on
    what all vectors have in common; it is measured on vectors that were not learned from. Bits of
    random rotations (short samples, `other` dimensions) separate with probability angle / pi. A pair
    that agrees in a share p of the bits agrees in a table with p ** bits; the number of tables is the
    least with the mean recall at the threshold, closer pairs fare better. Longer substrings need more
    tables, shorter ones more comparisons (2 ** -bits of all pairs a table): the cheaper sum is taken.
    """
    measured = len(sample) >= sample.shape[1] and len(held) > 0
    shares = [agreement(sample, held, threshold)] if measured else []
    if other or not measured:
        shares.append(np.array([1 - acos(threshold) / pi]))

    def needed(p: np.ndarray, bits: int) -> int:
        miss = 1 - p**bits
        lo, hi = 0, 1
        while (miss**hi).mean() > 1 - recall and hi < 1 << 40:
            lo, hi = hi, hi * 2
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if (miss**mid).mean() > 1 - recall else (lo, mid)
        return hi

    # A comparison costs about 2.3 entries of a table.
    tables = {b: max(needed(p, b) for p in shares) for b in range(57)}
    bits = min(tables, key=lambda b: tables[b] * (1 + 2.3 * n * 2.0**-b))
    return Tables(bits, tables[bits], sample)


class FirstTable:
    """Which pairs of rows do not agree in an earlier table. Rows of pairs are coded once, no others."""

    def __init__(self, code: Coder, x: np.ndarray, table: np.ndarray):
        self.code, self.x, self.table = code, x, table
        self.slot, self.codes = np.full(len(x), -1), np.empty((0, code.t.tables), np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        t = self.code.t
        new = np.unique(np.concatenate([a, b]))
        new = new[self.slot[new] < 0]
        if len(new):
            self.slot[new] = len(self.codes) + np.arange(len(new))
            size = max(1, (1 << 22) // max(1, t.bits * t.tables))
            self.codes = np.concatenate([self.codes, *[self.code(self.x[new[k : k + size]]) for k in range(0, len(new), size)]])
        out, step = np.zeros(len(a), bool), max(1, (1 << 21) // t.tables)
        for k in range(0, len(a), step):
            u, v = a[k : k + step], b[k : k + step]
            out[k : k + step] = (self.codes[self.slot[u]] == self.codes[self.slot[v]]).argmax(1) == self.table[u]
        return out


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.9,
    recall: float = 0.98,
    sample: int = 2000,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(id, n_links, component_id, kept) per input row; links have a cosine of `threshold` or more.

    Rotations are learned on at most `sample` vectors, the first by hash, and the number of tables
    follows from how a quarter as many others agree in them; all vectors are indexed.
    Equal vectors are compared once and counted by their number. Vectors that agree in a substring
    of their codes meet in blocks (see blocks.py) and are compared by the cosine of the originals;
    a pair counts in the first table where it agrees, so no pair is counted twice and none is
    emitted: blocks return counts and a spanning forest. Every link is verified; the share of links
    found is about `recall` at the threshold and higher above it.

    Vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null
    id, link with nothing. Vectors of different lengths never link. Repeated rows are vectors of
    their own. An empty table gives an empty result. Other columns of the input are not read.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).alias("_v"))
    key = [F.xxhash64("_v").alias("_a"), F.xxhash64(F.lit(17), F.col("_v")).alias("_b")]
    good = v.where(F.col("_id").isNotNull() & usable(F.col("_v")))
    reps = good.select("_id", "_v", *key).groupBy("_a", "_b")
    reps = materialize(reps.agg(F.min("_id").alias("_rep"), F.count(F.lit(1)).alias("_copies"), F.first("_v").alias("_v")), "vectors")
    some = reps.select("_v").orderBy(F.xxhash64("_v")).limit(sample + sample // 4).toArrow()["_v"]
    parts = list(by_length(some)) if len(some) else []
    most = max((x for _, x in parts), key=len, default=np.empty((0, 1)))
    own = most[: min(sample, len(most) - len(most) // 5)]
    tables = plan(reps.count(), threshold, recall, own, most[len(own) :], len(parts) > 1)
    rows_at_once = max(1, min(1024, (1 << 22) // max(1, tables.bits * tables.tables)))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Coder(tables)
        for b in batches:
            for at, x in by_length(b.column(1)):
                for lo in range(0, len(at), rows_at_once):
                    c, rows = code(x[lo : lo + rows_at_once]), b.column(0).take(pa.array(at[lo : lo + rows_at_once]))
                    rep = np.repeat(rows.to_numpy(), tables.tables)
                    table = np.tile(np.arange(tables.tables, dtype=np.int32), len(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(table), pa.array(c.ravel())], ["_rep", "_t", "_s"])

    entries = materialize(reps.select("_rep", "_v").mapInArrow(keys, "_rep long, _t int, _s long"), "codes")
    full = entries.groupBy("_t", "_s").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1").select("_t", "_s")
    met = entries.join(full, ["_t", "_s"], "left_semi").join(reps.select("_rep", "_copies", "_v"), "_rep")
    met = B.block_pairs(met, ["_t", "_s"], "_rep")
    met = B.together(met.select("_t", "_s", "_i", "_j", "_c", "_rep", "_copies", "_v"), ["_t", "_s"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Coder(tables)
        for t, group in B.runs(batches, ["_t", "_s", "_i", "_j"]):
            i, j, c, table, rep, copies = (t[k].to_numpy() for k in ("_i", "_j", "_c", "_t", "_rep", "_copies"))
            links, edges = np.zeros(len(group), np.int64), []
            for at, x in by_length(t["_v"]):
                first_table = FirstTable(code, x, table[at])
                for a, b in B.pairs(group[at], i[at], j[at], c[at]):
                    near = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
                    first = first_table(a[near], b[near])
                    a, b = at[a[near][first]], at[b[near][first]]
                    np.add.at(links, a, copies[b])
                    np.add.at(links, b, copies[a])
                    edges.append((a, b))
            a, b = (np.concatenate([e[k] for e in edges]) if edges else np.empty(0, np.int64) for k in (0, 1))
            top, k = B.roots(len(group), a, b), np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(rep[k]), pa.array(links[k]), pa.array(rep[top[k]])], ["_rep", "links", "peer"])

    found = materialize(met.mapInArrow(compare, "_rep long, links long, peer long"), "links")
    links = found.groupBy("_rep").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("_rep").alias("a"), F.col("peer").alias("b")))
    known = reps.join(links, "_rep", "left").join(comp, F.col("_rep") == F.col("id"), "left")
    known = known.select("_a", "_b", (F.coalesce("links", F.lit(0)) + F.col("_copies") - 1).alias("n_links"), F.coalesce("component", "_rep").alias("component_id"))
    mine = F.col("_id").isNotNull() & usable(F.col("_v"))
    out = v.select("_id", *[F.when(mine, k).alias(n) for k, n in zip(key, ("_a", "_b"), strict=True)]).join(known, ["_a", "_b"], "left")
    component = F.coalesce("component_id", "_id")
    return out.select(
        F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(component == F.col("_id"), F.lit(False)).alias("kept"),
    )
