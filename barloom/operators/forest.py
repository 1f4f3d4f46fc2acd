"""Boosted trees for every symbol and side, grown together on shared histograms.

All models advance one tree level per job: a task adds up gradients by (model, node, feature, bin)
over its rows, the tasks' histograms are added in a shuffle, and each node's best split is found
where its histogram ends up. Only splits reach the driver. Gradients are rounded to fixed point
before they are added, so sums, splits and models do not depend on how the rows are dealt to tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.model import Params
from barloom.session import materialize

BINS = 32
UNIT = float(1 << 24)  # gradients are whole multiples of 1 / UNIT
RIDGE = 1.0  # added to a node's second derivatives
ACCURACY = 10_000  # of the quantile sketch that places the bin edges
STORE = 16  # trees after which the rows' margins are written out
TOGETHER = 1000  # models that grow in the same jobs, at most
TRAIN, TEST = 1, 2  # roles; 0: no part


@dataclass(frozen=True)
class Spec:
    """One model: which symbol's rows, which label, which column of roles, which features."""

    symbol: str
    label: int
    params: Params = Params()
    part: int = 0
    features: tuple[int, ...] | None = None  # indices; None: all
    name: str = ""


@dataclass
class Model:
    """Trees of one spec, levels in order: per inner node its feature (-1: none, all rows go left) and last bin on the left; values per leaf."""

    spec: Spec
    feature: list[np.ndarray] = field(default_factory=list)
    last: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)
    gain: dict[int, float] = field(default_factory=dict)
    losses: list[tuple[float, float]] = field(default_factory=list)  # per number of trees: on rows of role TRAIN, TEST
    done: bool = False

    def keep(self, trees: int) -> None:
        self.feature, self.last, self.value = self.feature[:trees], self.last[:trees], self.value[:trees]


def bin_edges(cells: DataFrame, bins: int = BINS) -> DataFrame:
    """(symbol, feature, edges): up to bins - 1 quantiles of each series, from a mergeable sketch."""
    shares = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    found = cells.groupBy("symbol", "feature").agg(F.percentile_approx("value", shares, F.lit(ACCURACY)).alias("edges"))
    return found.withColumn("edges", F.array_sort(F.array_distinct("edges")))


def binned(cells: DataFrame, edges: DataFrame, names: Sequence[str], *extra: str) -> DataFrame:
    """(symbol, bar_ts, extra..., bins): one byte per feature, put together from long cells by aggregation.

    A cell's bin is the number of edges below its value; missing cells are in bin 0. `names` gives
    the order of the features, and cells of others are left out.
    """
    index = {n: k for k, n in enumerate(names)}
    n = len(names)
    order = cells.sparkSession.createDataFrame(list(index.items()), "feature string, _k int")
    at = F.size(F.filter("edges", lambda e: e < F.col("value")))
    long = cells.join(edges.join(order, "feature"), ["symbol", "feature"])  # the right side has a row per series
    long = long.select("symbol", "bar_ts", *extra, "_k", at.cast("byte").alias("_bin")).where("_bin >= 0")
    rows = long.groupBy("symbol", "bar_ts", *extra).agg(F.collect_list(F.struct("_k", "_bin")).alias("_cells"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = b.column(b.num_columns - 1)
            flat = c.flatten()
            out = np.zeros((b.num_rows, n), np.uint8)
            out[np.repeat(np.arange(b.num_rows), np.diff(c.offsets.to_numpy())), flat.field(0).to_numpy()] = flat.field(1).to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([x.tobytes() for x in out], pa.binary())], [*b.schema.names[:-1], "bins"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(pack, f"{kinds}, bins binary")


def prepared(rows: DataFrame, labels: Sequence[str], roles: Sequence[str]) -> DataFrame:
    """Rows (symbol, bar_ts, bins, labels, roles, margins) as a table in which a symbol's rows stand together in each file.

    `labels` are columns of 0, 1 or null; `roles` columns of TRAIN, TEST or 0. A symbol's rows go to
    as many tasks as they need.
    """
    out = rows.select(
        "symbol", "bar_ts", "bins",
        F.array(*[F.coalesce(F.col(c).cast("int"), F.lit(-1)) for c in labels]).alias("labels"),
        F.array(*[F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in roles]).alias("roles"),
        F.array().cast("array<double>").alias("margins"),
    )
    out = out.repartition("symbol", F.pmod(F.xxhash64("bar_ts"), F.lit(_shares(rows)))).sortWithinPartitions("symbol", "bar_ts")
    return materialize(out, "binned")


def _shares(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _uniform(keys: np.ndarray, tree: int) -> np.ndarray:
    """A fixed number in [0, 1) per row and tree."""
    x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((tree + 1) * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))).astype(np.float64) / 2.0**64


def _leaf(bins: np.ndarray, feature: np.ndarray, last: np.ndarray, levels: int) -> np.ndarray:
    """Node that each row reaches after so many levels of a tree."""
    node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    for level in range(levels):
        at = (1 << level) - 1 + node
        f = feature[at]
        node = 2 * node + ((f >= 0) & (bins[rows, np.maximum(f, 0)] > last[at]))
    return node


def _margin(start: np.ndarray, bins: np.ndarray, m: Model, first: int) -> np.ndarray:
    out = start.copy()
    for k in range(first, len(m.value)):
        out += m.value[k][_leaf(bins, m.feature[k], m.last[k], m.spec.params.depth)]
    return out


def _by_symbol(b: pa.RecordBatch, width: int) -> Iterator[tuple[str, slice, np.ndarray]]:
    """Runs of rows of one symbol with their bins."""
    symbol = b.column(b.schema.get_field_index("symbol")).to_pylist()
    raw = b.column(b.schema.get_field_index("bins"))
    lo = 0
    for k in range(1, len(symbol) + 1):
        if k == len(symbol) or symbol[k] != symbol[lo]:
            part = raw.slice(lo, k - lo)
            yield symbol[lo], slice(lo, k), np.frombuffer(b"".join(part.to_pylist()), np.uint8).reshape(k - lo, width)
            lo = k


def _matrix(b: pa.RecordBatch, name: str, rows: slice) -> np.ndarray:
    c = b.column(b.schema.get_field_index(name)).slice(rows.start, rows.stop - rows.start)
    flat = c.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(c), -1)


def _starts(b: pa.RecordBatch, rows: slice, count: int) -> np.ndarray:
    got = _matrix(b, "margins", rows)
    return got if got.shape[1] else np.zeros((rows.stop - rows.start, count))


def _histograms(models: list[Model], level: int, first: int, width: int, bins: int):
    """Tasks' histograms (model, node, sums of gradients and of second derivatives by feature and bin), and losses as node -1."""
    mine: dict[str, list[tuple[int, int]]] = {}  # symbol: (model, its place among the symbol's models)
    for i, m in enumerate(models):
        own = mine.setdefault(m.spec.symbol, [])
        own.append((i, len(own)))
    cells = width * bins

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        now = None

        def out() -> pa.RecordBatch:
            keys = list(held)
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([held[k].tobytes() for k in keys], pa.binary())],
                ["model", "node", "sums"],
            )

        for b in batches:
            stamps = b.column(b.schema.get_field_index("bar_ts")).cast(pa.int64()).to_numpy(zero_copy_only=False)
            for symbol, rows, x in _by_symbol(b, width):
                if symbol != now and held:
                    yield out()
                    held = {}
                now = symbol
                if symbol not in mine:
                    continue
                labels, roles, start = _matrix(b, "labels", rows), _matrix(b, "roles", rows), _starts(b, rows, len(mine[symbol]))
                offset = np.arange(width) * bins
                for i, place in mine[symbol]:
                    m = models[i]
                    if m.done or level >= m.spec.params.depth:
                        continue
                    y, role = labels[:, m.spec.label], roles[:, m.spec.part]
                    trees = len(m.value) - (level > 0)
                    used = (y >= 0) & (role > 0)
                    if not used.any():
                        continue
                    z, y, role, v = start[used, place], y[used], role[used], x[used]
                    # The last entry of each list is the tree being grown, whose values are not known yet.
                    for k in range(first, trees):
                        z = z + m.value[k][_leaf(v, m.feature[k], m.last[k], m.spec.params.depth)]
                    p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
                    if level == 0:
                        loss = -np.log(np.where(y == 1, p, 1 - p).clip(1e-15))
                        sums = np.array([[loss[role == r].sum(), (role == r).sum()] for r in (TRAIN, TEST)]).ravel()
                        key = (i, -1)
                        held[key] = held.get(key, 0) + sums
                    take = role == TRAIN
                    if m.spec.params.subsample < 1:
                        take &= _uniform(stamps[rows][used], trees) < m.spec.params.subsample
                    if not take.any():
                        continue
                    v, p, y = v[take], p[take], y[take]
                    node = _leaf(v, m.feature[-1], m.last[-1], level) if level else np.zeros(len(v), np.int64)
                    g, h = np.round((p - y) * UNIT), np.round(p * (1 - p) * UNIT)
                    nodes, slot = np.unique(node, return_inverse=True)
                    at = (slot[:, None] * cells + offset + v).ravel()
                    both = [np.bincount(at, np.repeat(w, width), len(nodes) * cells).reshape(len(nodes), cells) for w in (g, h)]
                    for s, k in enumerate(nodes):
                        key = (i, int(k))
                        held[key] = held.get(key, 0) + np.concatenate([both[0][s], both[1][s]])
        if held:
            yield out()

    return add


def _best(models: list[Model], width: int, bins: int):
    """Best split of each (model, node) from the sum of its histograms; losses pass through as node -1."""
    specs = [m.spec for m in models]

    def split(key: tuple[int, int], sums: np.ndarray) -> list[tuple]:
        model, node = key
        if node < 0:
            return [(model, node, -1, 0, 0.0, *map(float, sums))]
        g, h = sums.reshape(2, width, bins) / UNIT
        total_g, total_h = float(g[0].sum()), float(h[0].sum())
        left_g, left_h = g.cumsum(1)[:, :-1], h.cumsum(1)[:, :-1]
        right_g, right_h = total_g - left_g, total_h - left_h
        gain = left_g**2 / (left_h + RIDGE) + right_g**2 / (right_h + RIDGE) - total_g**2 / (total_h + RIDGE)
        gain = np.where((left_h > 0) & (right_h > 0), gain, 0.0)
        if specs[model].features is not None:
            closed = np.ones(width, bool)
            closed[list(specs[model].features)] = False
            gain[closed] = 0.0
        f, k = np.unravel_index(int(gain.argmax()), gain.shape)
        if gain[f, k] <= 1e-9:
            return [(model, node, -1, bins, 0.0, total_g, total_h, 0.0, 0.0)]
        return [(model, node, int(f), int(k), float(gain[f, k]), float(left_g[f, k]), float(left_h[f, k]), float(right_g[f, k]), float(right_h[f, k]))]

    names = ["model", "node", "feature", "last", "gain", "lg", "lh", "rg", "rh"]

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for b in batches:
            found = []
            for model, node, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                sums = np.frombuffer(raw.as_buffer(), np.float64)
                if (model, node) != key:
                    if key is not None:
                        found += split(key, total)
                    key, total = (model, node), np.zeros(len(sums))
                total = total + sums
            if found:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in found], SPLITS)
        if key is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in split(key, total)], SPLITS)

    return reduce


SPLITS = pa.schema([("model", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("last", pa.int32()), *[(c, pa.float64()) for c in ("gain", "lg", "lh", "rg", "rh")]])
SPLITS_SQL = "model int, node int, feature int, last int, gain double, lg double, lh double, rg double, rh double"


def grow(table: DataFrame, width: int, specs: Sequence[Spec], trees: int, patience: int = 0, bins: int = BINS) -> list[Model]:
    """Boosted trees of all specs, by logistic loss with second derivatives; `table` comes from `prepared`.

    With `patience`, a model stops once its loss on rows of role TEST has not fallen for so many
    trees, and keeps the trees up to the least. Ties go to the first feature and bin. Up to TOGETHER
    models grow in the same jobs; more take turns. A spec without training rows gets no trees.
    """
    out: list[Model] = []
    for lo in range(0, len(specs), TOGETHER):
        out += _grow([Model(s) for s in specs[lo : lo + TOGETHER]], table, width, trees, patience, bins)
    return out


def _grow(models: list[Model], table: DataFrame, width: int, trees: int, patience: int, bins: int) -> list[Model]:
    symbols = sorted({m.spec.symbol for m in models})
    rows = table.where(F.col("symbol").isin(symbols)) if len(symbols) <= 100 else table
    first = 0  # trees that the written margins hold already
    for tree in range(trees + 1):
        if tree and tree % STORE == 0 and tree < trees:
            rows, first = materialize(rows.mapInArrow(_stored(models, first, width), table.schema), "margins"), tree
        deepest = max((m.spec.params.depth for m in models if not m.done), default=0)
        for level in range(deepest):
            found = rows.mapInArrow(_histograms(models, level, first, width, bins), "model int, node int, sums binary")
            found = found.repartition("model", "node").sortWithinPartitions("model", "node")
            splits: dict[int, list] = {}
            for r in found.mapInArrow(_best(models, width, bins), SPLITS_SQL).collect():  # a row per open node of TOGETHER models
                splits.setdefault(r.model, []).append(r)
            for i, m in enumerate(models):
                if not m.done and level < m.spec.params.depth:
                    _apply(m, splits.get(i, []), level, tree, patience, last=tree == trees)
            if tree == trees:
                break
        if all(m.done for m in models):
            break
    return models


def _apply(m: Model, splits: list, level: int, tree: int, patience: int, last: bool) -> None:
    depth, step = m.spec.params.depth, m.spec.params.step
    if level == 0:
        losses = [r for r in splits if r.node < 0]
        if losses:
            a, n, b, k = losses[0].lg, losses[0].lh, losses[0].rg, losses[0].rh
            m.losses.append((a / n if n else float("nan"), b / k if k else float("nan")))
        splits = [r for r in splits if r.node >= 0]
        held = [x[1] for x in m.losses]
        if last or not splits or (patience and len(held) > patience and min(held) < min(held[-patience:])):
            m.done = True
            if patience and held and not np.isnan(held).all():
                m.keep(int(np.nanargmin(held)))
            return
        m.feature.append(np.full((1 << depth) - 1, -1, np.int32))
        m.last.append(np.full((1 << depth) - 1, 255, np.int32))
        m.value.append(np.zeros(1 << depth))
    value = lambda g, h: -step * g / (h + RIDGE)
    for r in splits:
        at, span = (1 << level) - 1 + r.node, 1 << (depth - level)
        leaves = m.value[-1][r.node * span : (r.node + 1) * span]
        if r.feature < 0:
            leaves[:] = value(r.lg, r.lh)
            continue
        m.feature[-1][at], m.last[-1][at] = r.feature, r.last
        m.gain[r.feature] = m.gain.get(r.feature, 0.0) + r.gain
        leaves[: span // 2], leaves[span // 2 :] = value(r.lg, r.lh), value(r.rg, r.rh)


def _stored(models: list[Model], first: int, width: int):
    mine: dict[str, list[Model]] = {}
    for m in models:
        mine.setdefault(m.spec.symbol, []).append(m)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            margins: list[list[float]] = []
            for symbol, rows, x in _by_symbol(b, width):
                own = mine.get(symbol, [])
                start = _starts(b, rows, len(own))
                now = [_margin(start[:, k], x, m, first) for k, m in enumerate(own)]
                margins += np.stack(now, 1).tolist() if own else [[]] * len(x)
            k = b.schema.get_field_index("margins")
            yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array(margins, pa.list_(pa.float64()))], b.schema.names)

    return add


def score(table: DataFrame, width: int, models: Sequence[Model]) -> DataFrame:
    """(model, symbol, bar_ts, label, role, margin, pred) of each model's symbol's rows; `table` comes from `prepared`."""
    mine: dict[str, list[tuple[int, Model]]] = {}
    for i, m in enumerate(models):
        mine.setdefault(m.spec.symbol, []).append((i, m))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for symbol, rows, x in _by_symbol(b, width):
                labels, roles = _matrix(b, "labels", rows), _matrix(b, "roles", rows)
                for i, m in mine.get(symbol, ()):
                    z = _margin(np.zeros(len(x)), x, m, 0)
                    y = labels[:, m.spec.label]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(x), i, np.int32)), pa.array([symbol] * len(x), pa.string()), b.column(b.schema.get_field_index("bar_ts")).slice(rows.start, len(x)),
                         pa.array(y.astype(np.int32), mask=y < 0), pa.array(roles[:, m.spec.part].astype(np.int32)), pa.array(z), pa.array((z > 0).astype(np.int32))],
                        ["model", "symbol", "bar_ts", "label", "role", "margin", "pred"],
                    )

    plain = table.select("symbol", "bar_ts", "bins", "labels", "roles")
    return plain.mapInArrow(apply, "model int, symbol string, bar_ts timestamp, label int, role int, margin double, pred int")
