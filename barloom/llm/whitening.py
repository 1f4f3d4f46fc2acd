"""Embedding whitening by a bidiagonal qd solver.

Blockwise QR reduces the centred rows to one triangle, task by task and then in a tree of tasks;
Householder reflections make the triangle bidiagonal, dqds finds its singular values, and twisted
factorisations give the whitening directions. Only sums and triangles of the size of one vector's
dimension squared reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import bidiagonal
from barloom.session import materialize

FANOUT = 16  # triangles that one task of the tree reduces
GRID, OFFSET = 64, 1_000_000  # fixed values: entries become floor(64 c) + 1000000


def matrix(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, values) of the usable vectors of a list column, or of those of one dimension.

    With `dim` None, values holds each usable vector's length instead. Usable: not null, without
    null or non-finite entries.
    """
    column = column.cast(pa.large_list(pa.float64()))
    n = len(column)
    off = column.offsets.to_numpy().astype(np.int64)
    flat = column.values
    bad = ~np.isfinite(flat.fill_null(float("nan")).to_numpy(zero_copy_only=False))
    faults = np.concatenate([[0], np.cumsum(bad)])
    ok = column.is_valid().to_numpy(zero_copy_only=False) & (faults[off[1:]] == faults[off[:-1]])
    size = off[1:] - off[:-1]
    if dim is None:
        rows = np.flatnonzero(ok)
        return rows, size[rows]
    rows = np.flatnonzero(ok & (size == dim)) if n else np.empty(0, np.int64)
    at = off[rows][:, None] + np.arange(dim)
    return rows, flat.fill_null(0.0).to_numpy(zero_copy_only=False)[at] if len(rows) else np.empty((0, dim))


def lattice(values: np.ndarray) -> np.ndarray:
    return np.floor(values * GRID).astype(np.int64) + OFFSET


@dataclass(frozen=True)
class Totals:
    """What a fit knows of all vectors: their dimension, number and sum, as exact integers."""

    dim: int
    n: int
    sums: tuple[int, ...]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: the whole part of the mean is taken off exactly, its fraction after that."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        fraction = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - whole) - fraction

    def deviations(self, x: np.ndarray) -> list[Decimal]:
        """Sum over dimensions of (n x - S)^2, exact: n^2 Q - 2 n P + R with sums Q, P, R of small integers."""
        n = self.n
        whole, rest = [s // n for s in self.sums], [s % n for s in self.sums]
        y = x - np.array(whole, np.int64)
        reach = int(np.abs(y).max(initial=0)) if len(y) else 0
        if self.dim * reach * max(reach, n) < 1 << 62:
            q, p = (y * y).sum(1).tolist(), (y * np.array(rest, np.int64)).sum(1).tolist()
        else:
            q = [sum(v * v for v in row) for row in y.tolist()]
            p = [sum(v * r for v, r in zip(row, rest, strict=True)) for row in y.tolist()]
        r = sum(v * v for v in rest)
        return [Decimal(n * n * a - 2 * n * b + r) for a, b in zip(q, p, strict=True)]


def totals(vectors: DataFrame) -> Totals | None:
    """Dimension (that of most usable vectors, the larger on a tie), number and sums; None without vectors."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dim, n = np.unique(matrix(b.column(0))[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(dim, pa.int64()), pa.array(n, pa.int64())], ["dim", "n"])

    top = vectors.mapInArrow(sizes, "dim long, n long").where("dim > 0").groupBy("dim").agg(F.sum("n").alias("n"))
    top = top.orderBy(F.col("n").desc(), F.col("dim").desc()).first()
    if top is None:
        return None
    dim, n = int(top[0]), int(top[1])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, v = matrix(b.column(0), dim)
            if len(v):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(lattice(v).sum(0))], ["at", "s"])

    by_dim = vectors.mapInArrow(sums, "at long, s long").groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found = {r[0]: int(r[1]) for r in by_dim.collect()}  # one row per dimension
    return Totals(dim, n, tuple(found[k] for k in range(dim)))


def triangle(rows: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.concatenate(rows), mode="r")


def as_rows(part: int, r: np.ndarray) -> pa.RecordBatch:
    blobs = pa.array([x.tobytes() for x in r], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([part] * len(r), pa.int64()), pa.array(range(len(r)), pa.int64()), blobs], ["part", "at", "row"])


def reduced(vectors: DataFrame, t: Totals) -> np.ndarray:
    """The triangle R with R^T R = (centred rows)^T (centred rows).

    Each task keeps one triangle and takes in blocks of rows; the tasks' triangles are reduced
    FANOUT at a time, in tasks again, until one is left.
    """
    block = max(1024, 4 * t.dim)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r, held = np.empty((0, t.dim)), []
        for b in batches:
            _, v = matrix(b.column(0), t.dim)
            for lo in range(0, len(v), block):
                held.append(t.centred(lattice(v[lo : lo + block])))
                if sum(map(len, held)) >= block:
                    r, held = triangle([r, *held]), []
        if held:
            r = triangle([r, *held])
        if len(r):
            yield as_rows(TaskContext.get().partitionId(), r)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, r, held = None, np.empty((0, t.dim)), []
        for b in batches:
            for p, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if p != part and part is not None:
                    yield as_rows(part, triangle([r, *held]))
                    r, held = np.empty((0, t.dim)), []
                part = p
                held.append(np.frombuffer(blob)[None, :])
                if len(held) >= block:
                    r, held = triangle([r, *held]), []
        if part is not None:
            yield as_rows(part, triangle([r, *held]))

    schema = "part long, at long, row binary"
    now = materialize(vectors.mapInArrow(first, schema), "triangles")
    last = now.agg(F.max("part")).first()[0]
    while last:
        dealt = now.select(F.expr(f"part div {FANOUT}").alias("up"), "part", "at", "row").repartition("up")
        dealt = dealt.sortWithinPartitions("up", "part", "at").select("up", "row")
        now, last = materialize(dealt.mapInArrow(merge, schema), "triangles"), last // FANOUT
    return np.array([np.frombuffer(r[0]) for r in now.orderBy("at").select("row").collect()])  # one triangle


@dataclass(frozen=True)
class Whitening:
    """Directions (columns, over the root of their variance; zero where there is none), variances, all variance."""

    totals: Totals
    directions: np.ndarray
    variances: np.ndarray
    total: float

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.totals.centred(x) @ self.directions


def fit(vectors: DataFrame, components: int = 32) -> Whitening | None:
    """Totals, reduction and solution over all usable vectors; None without any."""
    t = totals(vectors)
    if t is None:
        return None
    r = reduced(vectors, t)
    squares, v = bidiagonal.right_singular(r, min(components, t.dim))
    squares = squares / t.n
    e = squares[: v.shape[1]]
    alive = e > (64 * t.dim * bidiagonal.EPS) ** 2 * e[0]
    directions = np.where(alive, v / np.sqrt(np.where(alive, e, 1.0)), 0.0)
    return Whitening(t, directions, np.where(alive, e, 0.0), float(squares.sum()))


def identity_error(vectors: DataFrame, w: Whitening) -> float | None:
    """Largest absolute entry of the whitened rows' covariance minus the identity, measured over all rows."""
    k = w.directions.shape[1]

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, any_row = np.zeros((k, k)), False
        for b in batches:
            _, v = matrix(b.column(0), w.totals.dim)
            for lo in range(0, len(v), 4096):
                y = w.apply(lattice(v[lo : lo + 4096]))
                gram, any_row = gram + y.T @ y, True
        if any_row:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(gram.ravel())], ["at", "g"])

    cells = vectors.mapInArrow(grams, "at long, g double").groupBy("at").agg(F.sum("g").alias("g")).collect()  # components squared
    cov = np.zeros(k * k)
    for at, g in cells:
        cov[at] = g / w.totals.n
    alive = w.variances > 0
    diff = np.abs(cov.reshape(k, k) - np.eye(k))[np.ix_(alive, alive)]
    return float(diff.max()) if alive.any() else None


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 32) -> DataFrame:
    """One row per usable vector and component: key, component, n, deviation, whitened, explained, identity_error.

    Entries become the integers floor(64 c) + 1000000; `n`, sums and `deviation` (the sum over
    dimensions of (n x - S)^2, a decimal) are exact integers over all usable vectors. Components are
    numbered from 1 by falling variance, `components` of them or as many as there are dimensions;
    `explained` is their share of all variance and `identity_error` the largest absolute entry of
    the whitened covariance minus the identity, measured over the rows.

    Vectors that are null or hold null or non-finite entries are left out, as are empty vectors and
    those of another length than most have (the longer on a tie). A component without variance, as
    when there are fewer vectors than dimensions, has null `whitened` and 0 `explained` (null if
    there is no variance at all). Equal variances have any orthogonal directions in their space.
    Null keys and repeated rows are kept; an empty table gives an empty result; other columns are
    not read. Entries must lie within 2^40.
    """
    d = df.select(F.col(key).alias("_key"), F.col(vector).alias("_v"))
    schema = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    kind = d.schema["_key"].dataType.simpleString()
    vectors = d.select("_v")
    w = fit(vectors, components)
    if w is None:
        return d.sparkSession.createDataFrame([], f"{key} {kind}, {schema}")
    error, k = identity_error(vectors, w), w.directions.shape[1]
    share = [float(e / w.total) if w.total else None for e in w.variances]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, v = matrix(b.column(1), w.totals.dim)
            for lo in range(0, len(v), 1024):
                x, at = lattice(v[lo : lo + 1024]), rows[lo : lo + 1024]
                m = len(x)
                y = np.where(w.variances > 0, w.apply(x), np.nan).ravel()
                each = np.repeat(np.arange(m), k)
                dev = pa.array(w.totals.deviations(x), pa.decimal128(38))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at)).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                     pa.array(np.full(m * k, w.totals.n)), dev.take(pa.array(each)), pa.array(y, from_pandas=True),
                     pa.array(share * m, pa.float64()), pa.array([error] * (m * k), pa.float64())],
                    [key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return d.mapInArrow(apply, f"{key} {kind}, {schema}")
