"""A model per symbol and side over all columns of the batch form: fit, select, search, keep, predict.

Cells stay long until a row's bins are put together; every step works on all symbols and sides at
once (see forest.py). Models are kept as a table of splits with real thresholds, by symbol and side.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.operators import cellblocks as C
from barloom.operators import forest as R
from barloom.operators import labels as L
from barloom.operators.model import Params, candidates
from barloom.session import materialize

SIDES = (("BUY", "label_buy"), ("SELL", "label_sell"))
LABELS = tuple(label for _, label in SIDES)


@dataclass
class Inputs:
    """What all fits share: labelled rows and their split, binned rows, the features' names in order, their edges, the symbols."""

    rows: DataFrame
    table: DataFrame
    names: tuple[str, ...]
    edges: DataFrame
    symbols: tuple[str, ...]
    folds: int

    def specs(self, params: Params = Params(), part: int = 0, features: dict[tuple[str, str], Sequence[str]] | None = None) -> list[R.Spec]:
        """One per symbol and side; `features` by (symbol, side) limits what a model may use."""
        at = {n: k for k, n in enumerate(self.names)}
        out = []
        for s in self.symbols:
            for k, (side, _) in enumerate(SIDES):
                chosen = tuple(at[n] for n in features[s, side]) if features else None
                out.append(R.Spec(s, k, params, part, chosen, side))
        return out


def inputs(cells: DataFrame, bars: DataFrame, period: float, names: Sequence[str], folds: int = 0, gap: int = 1, bins: int = R.BINS) -> Inputs:
    """Bins, labels and roles of every bar; cells are long or in blocks (see cellblocks.py).

    Role 0 is the time split (rows of `valid` only stop the boosting); with `folds`, roles 1, 2, ...
    are the forward-chaining folds. Edges are quantiles of the training rows alone.
    """
    names = tuple(names)
    labelled = materialize(L.labels(bars, period).select("symbol", "bar_ts", *LABELS), "labels")
    split = L.split_time(labelled, period).select("symbol", "bar_ts", *LABELS, "split")
    role = F.when(F.col("split") == "train", R.TRAIN).when(F.col("split") == "valid", R.TEST).otherwise(0)
    rows = split.select("symbol", "bar_ts", *LABELS, role.alias("role0"), "split")
    roles = ["role0"]
    if folds:
        code = F.when(F.col("role") == "train", R.TRAIN).otherwise(R.TEST)
        each = L.forward_folds(labelled, period, folds, gap)
        each = each.groupBy("symbol", "bar_ts").agg(*[F.max(F.when(F.col("fold") == k, code)).alias(f"role{k + 1}") for k in range(folds)])
        rows = rows.join(each, ["symbol", "bar_ts"], "left")
        roles += [f"role{k + 1}" for k in range(folds)]
    rows = materialize(rows, "roles")
    learnt = rows.where("role0 = 1").select("symbol", "bar_ts")
    train = C.of_bars(cells, learnt, period) if C.is_blocks(cells) else cells.join(learnt, ["symbol", "bar_ts"], "left_semi")
    edges = materialize(R.bin_edges(train.where(F.col("feature").isin(*names)) if len(names) <= 100 else train, bins), "edges")
    binned = C.binned(cells, edges, names, period) if C.is_blocks(cells) else R.binned(cells, edges, names)
    binned = binned.join(rows, ["symbol", "bar_ts"], "left")
    table = R.prepared(binned, LABELS, roles)
    symbols = tuple(sorted(r[0] for r in rows.select("symbol").distinct().collect()))  # names only; models take turns beyond TOGETHER
    return Inputs(rows, table, names, edges, symbols, folds)


def train(data: Inputs, trees: int = 100, patience: int = 15, params: Params = Params(), features: dict[tuple[str, str], Sequence[str]] | None = None) -> list[R.Model]:
    return R.grow(data.table, len(data.names), data.specs(params, 0, features), trees, patience)


def importances(model: R.Model, names: Sequence[str]) -> dict[str, float]:
    """Share of all gain by feature, greatest first."""
    total = sum(model.gain.values())
    found = sorted(model.gain.items(), key=lambda x: (-x[1], x[0]))
    return {names[k]: g / total for k, g in found} if total else {}


def select_features(data: Inputs, keep: int = 30, steps: int = 4, trees: int = 25, params: Params = Params()) -> tuple[dict[tuple[str, str], list[str]], list[R.Model]]:
    """Per symbol and side the `keep` most useful features, dropping the least useful in equal steps, and the last fit.

    Features of equal use stay in the order of their names' list.
    """
    names = list(data.names)
    left = {(s, side): names for s in data.symbols for side, _ in SIDES}
    drop = math.ceil(max(len(names) - keep, 0) / steps)
    models = R.grow(data.table, len(names), data.specs(params, 0, left), trees)
    while max(map(len, left.values()), default=0) > keep:
        place = {n: k for k, n in enumerate(names)}
        for m in models:
            key = (m.spec.symbol, m.spec.name)
            weight = importances(m, data.names)
            ranked = sorted(left[key], key=lambda n: (-weight.get(n, 0.0), place[n]))
            left[key] = sorted(ranked[: max(keep, len(ranked) - drop)], key=place.__getitem__)
        models = R.grow(data.table, len(names), data.specs(params, 0, left), trees)
    return left, models


def search(
    data: Inputs,
    features: dict[tuple[str, str], Sequence[str]] | None = None,
    count: int | None = None,
    min_trees: int = 25,
    max_trees: int = 500,
    factor: int = 10,
    seed: int = 42,
) -> DataFrame:
    """Random search with successive halving, for all symbols and sides at once: (symbol, side, trees, rank, f1, depth, step, subsample).

    The budget is boosting trees. A round fits every candidate left on every fold, side by side; each
    symbol and side keeps its best 1/factor by mean F1 over the folds and gives them factor times the
    trees. `count` defaults to as many candidates as leave one for the largest budget. `rank` 1 of
    the last round is the one chosen.
    """
    if not data.folds:
        raise ValueError("inputs were made without folds")
    rounds = 1 + int(math.log(max_trees / min_trees, factor) + 1e-9)
    drawn = candidates(count or factor ** (rounds - 1), seed)
    left = {(s.symbol, s.name): list(range(len(drawn))) for s in data.specs()}
    out, budget = [], min_trees
    for _ in range(rounds):
        specs, tags = [], []
        for base in data.specs(features=features):
            for c in left[base.symbol, base.name]:
                for fold in range(data.folds):
                    specs.append(replace(base, params=drawn[c], part=fold + 1))
                    tags.append((base.symbol, base.name, c, fold))
        models = R.grow(data.table, len(data.names), specs, budget)
        scored = fold_scores(data, models, tags)
        for (symbol, side), pool in left.items():
            pool.sort(key=lambda c: (-scored[symbol, side, c], c))
            out += [(symbol, side, budget, k + 1, scored[symbol, side, c], drawn[c].depth, drawn[c].step, drawn[c].subsample) for k, c in enumerate(pool)]
            left[symbol, side] = pool[: max(1, len(pool) // factor)]
        if max(map(len, left.values()), default=0) <= 1 and budget >= max_trees:
            break
        budget = min(budget * factor, max_trees)
    schema = "symbol string, side string, trees int, rank int, f1 double, depth int, step double, subsample double"
    return data.table.sparkSession.createDataFrame(out, schema)


def fold_scores(data: Inputs, models: list[R.Model], tags: list[tuple]) -> dict[tuple[str, str, int], float]:
    """Mean F1 of class 1 over the folds by (symbol, side, candidate); a row per model comes to the driver."""
    at = R.score(data.table, len(data.names), models).where(F.col("label").isNotNull() & (F.col("role") == R.TEST))
    hit, wrong = F.sum((F.col("label") * F.col("pred")).cast("long")), F.sum((F.col("label") != F.col("pred")).cast("long"))
    found = {r.model: 2 * r.hit / (2 * r.hit + r.wrong) if r.hit else 0.0 for r in at.groupBy("model").agg(hit.alias("hit"), wrong.alias("wrong")).collect()}
    sums: dict[tuple[str, str, int], float] = {}
    for i, (symbol, side, c, _) in enumerate(tags):
        sums[symbol, side, c] = sums.get((symbol, side, c), 0.0) + found.get(i, 0.0) / data.folds
    return sums


# ---- kept models -------------------------------------------------------------------------

TREES = "symbol string, side string, tree int, depth int, place int, feature string, threshold double, value double"


def tree_rows(data: Inputs, models: Sequence[R.Model]) -> DataFrame:
    """Models as rows: inner nodes by place (a row goes right if its value exceeds the threshold), then leaves with their values."""
    rows, splits = [], []
    for m in models:
        d = m.spec.params.depth
        if not m.value:  # a model without trees says 0 for all rows
            rows.append((m.spec.symbol, m.spec.name, 0, 0, 0, None, None, 0.0))
        for t in range(len(m.value)):
            for place, (f, last) in enumerate(zip(m.feature[t], m.last[t], strict=True)):
                if f >= 0:
                    splits.append((m.spec.symbol, m.spec.name, t, d, place, data.names[f], int(last)))
            rows += [(m.spec.symbol, m.spec.name, t, d, (1 << d) - 1 + k, None, None, float(v)) for k, v in enumerate(m.value[t])]
    spark = data.table.sparkSession
    inner = spark.createDataFrame(splits, "symbol string, side string, tree int, depth int, place int, feature string, last int")
    inner = inner.join(data.edges, ["symbol", "feature"]).select(
        "symbol", "side", "tree", "depth", "place", "feature", F.col("edges")[F.col("last")].alias("threshold"), F.lit(None).cast("double").alias("value")
    )
    return spark.createDataFrame(rows, TREES).unionByName(inner)


def save(trees: DataFrame, root: str) -> str:
    """One folder per symbol and side."""
    path = f"{root}/symbol_models"
    trees.write.mode("overwrite").partitionBy("symbol", "side").parquet(path)
    return path


def load(spark: SparkSession, root: str, symbol: str | None = None, side: str | None = None) -> DataFrame:
    trees = spark.read.schema(TREES).parquet(f"{root}/symbol_models")
    trees = trees.where(F.col("symbol") == symbol) if symbol else trees
    return trees.where(F.col("side") == side) if side else trees


def vectors(cells: DataFrame, names: Sequence[str]) -> DataFrame:
    """(symbol, bar_ts, at, x): each row's cells as a sparse vector, indices in `names` ascending; no pivot."""
    order = cells.sparkSession.createDataFrame(list(enumerate(names)), "_k int, feature string")
    long = cells.join(order, "feature").groupBy("symbol", "bar_ts").agg(F.array_sort(F.collect_list(F.struct("_k", "value"))).alias("c"))
    return long.select("symbol", "bar_ts", F.col("c._k").alias("at"), F.col("c.value").alias("x"))


def predict(cells: DataFrame, trees: DataFrame) -> DataFrame:
    """(symbol, bar_ts, side, margin, pred) for every bar of the cells and every kept model of its symbol.

    Cells that no split asks for are dropped before rows are put together; a missing cell goes left.
    The trees go out with the job: their number is a parameter of the fit, not of the rows.
    """
    names = sorted(r[0] for r in trees.where("feature is not null").select("feature").distinct().collect())
    at = {n: k for k, n in enumerate(names)}
    models: dict[str, dict[str, dict[int, tuple]]] = {}
    for r in trees.collect():
        own = models.setdefault(r.symbol, {}).setdefault(r.side, {})
        if r.tree not in own:
            own[r.tree] = (r.depth, np.full((1 << r.depth) - 1, -1), np.zeros((1 << r.depth) - 1), np.zeros(1 << r.depth))
        depth, feature, threshold, value = own[r.tree]
        if r.feature is None:
            value[r.place - len(feature)] = r.value
        else:
            feature[r.place], threshold[r.place] = at[r.feature], r.threshold

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            symbol = np.array(b.column(0).to_pylist(), object)
            x = np.full((b.num_rows, len(names)), -np.inf)
            row = np.repeat(np.arange(b.num_rows), np.diff(b.column(2).offsets.to_numpy()))
            x[row, b.column(2).flatten().to_numpy()] = b.column(3).flatten().to_numpy(zero_copy_only=False)
            x[np.isnan(x)] = -np.inf
            for s in dict.fromkeys(symbol):
                rows = np.flatnonzero(symbol == s)
                for side, own in sorted(models.get(s, {}).items()):
                    z = np.zeros(len(rows))
                    for t in sorted(own):
                        depth, feature, threshold, value = own[t]
                        node = np.zeros(len(rows), np.int64)
                        for level in range(depth):
                            k = (1 << level) - 1 + node
                            node = 2 * node + ((feature[k] >= 0) & (x[rows, np.maximum(feature[k], 0)] > threshold[k])) if len(names) else 2 * node
                        z += value[node]
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(rows)), b.column(1).take(pa.array(rows)), pa.array([side] * len(rows), pa.string()), pa.array(z), pa.array((z > 0).astype(np.int32))],
                        ["symbol", "bar_ts", "side", "margin", "pred"],
                    )

    rows = cells.select("symbol", "bar_ts").distinct().join(vectors(cells.where(F.col("feature").isin(names)), names), ["symbol", "bar_ts"], "left")
    empty = [F.coalesce("at", F.array().cast("array<int>")).alias("at"), F.coalesce("x", F.array().cast("array<double>")).alias("x")]
    return rows.select("symbol", "bar_ts", *empty).mapInArrow(apply, "symbol string, bar_ts timestamp, side string, margin double, pred int")


def newest(cells: DataFrame, bars: DataFrame, n: int = 2, period: float | None = None) -> DataFrame:
    """Long cells of the last n bars of each symbol; cells in blocks need the period."""
    last = F.expr(f"slice(sort_array(collect_set(bar_ts), false), 1, {n})")
    top = bars.groupBy("symbol", F.window("bar_ts", "30 days").alias("_w")).agg(last.alias("t")).groupBy("symbol").agg(F.flatten(F.collect_list("t")).alias("t"))
    stamps = top.select("symbol", F.explode(F.expr(f"slice(sort_array(t, false), 1, {n})")).alias("bar_ts"))
    return C.of_bars(cells, stamps, period) if C.is_blocks(cells) else cells.join(stamps, ["symbol", "bar_ts"], "left_semi")


def orders_input(predictions: DataFrame, desk: DataFrame) -> DataFrame:
    """Desk rows with the newest prediction of either side as pred_buy and pred_sell (0 without a model)."""
    latest = Window.partitionBy("symbol", "side").orderBy(F.col("bar_ts").desc())  # a few rows per symbol and side
    last = predictions.withColumn("_r", F.row_number().over(latest)).where("_r = 1").groupBy("symbol").agg(
        *[F.max(F.when(F.col("side") == side, F.col("pred"))).alias(f"pred_{side.lower()}") for side, _ in SIDES]
    )
    names = [f"pred_{side.lower()}" for side, _ in SIDES]
    return desk.drop(*names).join(last, "symbol", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in names})
