"""Trees grown together against plain ones grown one by one, and kept models against the fitted ones."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import forest as R
from barloom.operators import symbol_models as M
from barloom.operators.model import Params
from barloom.session import new_path

NAMES = [f"f{k}" for k in range(5)]
N = 260


def make(spark):
    r, parts = np.random.default_rng(1), []
    for s in "ABC":
        x = r.standard_normal((N, 5)).round(2)
        close = 100 + np.cumsum(np.where(x[:, 0] + x[:, 1] > 0.4 * (s == "B"), 1.0, -1.0) + 0.1 * r.standard_normal(N))
        d = pd.DataFrame(x, columns=NAMES)
        d["close"] = np.concatenate([[100.0], close[:-1]])  # a bar's features tell the next bar's direction
        d["symbol"], d["bar_ts"] = s, pd.date_range("2024-01-01", periods=N, freq="h")
        parts.append(d)
    df = spark.createDataFrame(pd.concat(parts))
    cells = df.unpivot(["symbol", "bar_ts"], NAMES, "feature", "value")
    return df.select("symbol", "bar_ts", "close"), cells


@pytest.fixture(scope="module")
def data(spark):
    bars, cells = make(spark)
    return bars, cells, M.inputs(cells.repartition(5), bars, 3600, NAMES, folds=3, gap=1)


def rows_of(data):
    pdf = data.table.toPandas().sort_values(["symbol", "bar_ts"])
    x = np.stack([np.frombuffer(b, np.uint8) for b in pdf["bins"]])
    return pdf["symbol"].to_numpy(), x, np.stack(pdf["labels"].to_numpy()), np.stack(pdf["roles"].to_numpy())


def plain_trees(x, y, trees, p, allowed):
    """The same boosting for one model, by loops over nodes, features and bins."""
    z, out = np.zeros(len(x)), []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-z))
        g, h = np.round((q - y) * R.UNIT) / R.UNIT, np.round(q * (1 - q) * R.UNIT) / R.UNIT
        node, splits = np.zeros(len(x), int), {}
        for level in range(p.depth):
            for k in range(1 << level):
                rows = np.flatnonzero(node == k)
                best = (1e-9, None)
                for f in allowed:
                    for b in range(R.BINS - 1):
                        left = rows[x[rows, f] <= b]
                        right = rows[x[rows, f] > b]
                        if not len(left) or not len(right):
                            continue
                        gain = sum(g[i].sum() ** 2 / (h[i].sum() + R.RIDGE) for i in (left, right)) - g[rows].sum() ** 2 / (h[rows].sum() + R.RIDGE)
                        if gain > best[0] + 1e-12:
                            best = (gain, (f, b))
                splits[level, k] = best[1]
            new = 2 * node
            for i in range(len(x)):
                s = splits[level, node[i]]
                new[i] += s is not None and x[i, s[0]] > s[1]
            node = new
        value = {k: -p.step * g[node == k].sum() / (h[node == k].sum() + R.RIDGE) for k in set(node)}
        z = z + np.array([value[k] for k in node])
        out.append(splits)
    return out, z


def test_equal_to_separate_fits(data):
    _, _, d = data
    symbol, x, labels, roles = rows_of(d)
    p = Params(depth=2, step=0.3)
    specs = [R.Spec("A", 0, p), R.Spec("B", 1, p), R.Spec("C", 0, p, 2, (0, 3))]
    models = R.grow(d.table, len(NAMES), specs, 4)
    scored = R.score(d.table, len(NAMES), models).toPandas().sort_values(["model", "bar_ts"])
    for i, (s, m) in enumerate(zip(specs, models, strict=True)):
        use = (symbol == s.symbol) & (labels[:, s.label] >= 0) & (roles[:, s.part] == R.TRAIN)
        trees, z = plain_trees(x[use], labels[use, s.label], 4, p, s.features or range(5))
        for t, splits in enumerate(trees):
            for (level, k), want in splits.items():
                f = m.feature[t][(1 << level) - 1 + k]
                assert (None if f < 0 else (f, m.last[t][(1 << level) - 1 + k])) == want
        mine = scored[scored.model == i]["margin"].to_numpy()[use[symbol == s.symbol]]
        assert np.allclose(mine, z, atol=1e-12)


def test_partitions_and_written_margins_change_nothing(spark, data, monkeypatch):
    _, _, d = data
    specs = d.specs(Params(depth=3, step=0.2, subsample=0.8))
    one = R.grow(d.table, len(NAMES), specs, 7)
    monkeypatch.setattr(R, "STORE", 3)
    monkeypatch.setattr(R, "TOGETHER", 4)
    two = R.grow(d.table.repartition(11).sortWithinPartitions("symbol"), len(NAMES), specs, 7)
    for a, b in zip(one, two, strict=True):
        assert [x.tolist() for x in a.feature] == [x.tolist() for x in b.feature] and [x.tolist() for x in a.last] == [x.tolist() for x in b.last]
        assert np.allclose(np.concatenate(a.value), np.concatenate(b.value)) and np.allclose(a.losses, b.losses)


def test_early_stop_keeps_the_best(data):
    _, _, d = data
    for m in M.train(d, 60, 4, Params(depth=3, step=0.8)):
        held = [b for _, b in m.losses]
        assert len(m.value) == int(np.argmin(held)) < 60 and m.losses[0][0] == pytest.approx(np.log(2))


def test_models_learn_and_kept_ones_agree(spark, data):
    bars, cells, d = data
    models = M.train(d, 20, 0, Params(depth=3, step=0.3))
    models[3].keep(0)  # a model may end without a tree
    root = new_path(spark, "test-models")
    M.save(M.tree_rows(d, models), root)
    odd = spark.createDataFrame([("A", None, "f0", 1.0), ("Z", None, "f0", None)], "symbol string, bar_ts timestamp, feature string, value double")
    again = M.predict(cells.unionByName(odd), M.load(spark, root)).where("bar_ts is not null")
    fitted = R.score(d.table, len(NAMES), models).withColumn("side", F.element_at(F.array(*[F.lit(m.spec.name) for m in models]), F.col("model") + 1))
    both = again.join(fitted.withColumnRenamed("margin", "fit"), ["symbol", "side", "bar_ts"]).toPandas()
    assert len(both) == 3 * 2 * N and np.allclose(both["margin"], both["fit"], atol=1e-12)
    seen = both[(both.role > 0) & both.label.notna() & (both.fit != 0)]
    assert (seen[seen.role == R.TRAIN].label == (seen[seen.role == R.TRAIN].fit > 0)).mean() > 0.9
    one = M.load(spark, root, "B", "SELL")
    assert {(r.symbol, r.side) for r in one.select("symbol", "side").distinct().collect()} == {("B", "SELL")}
    last = M.predict(M.newest(cells, bars, 2), one).collect()
    assert len(last) == 2 and {r.symbol for r in last} == {"B"}


def test_selection_keeps_what_tells(data):
    _, _, d = data
    kept, models = M.select_features(d, keep=2, steps=2, trees=8, params=Params(depth=2, step=0.3))
    assert all(v == ["f0", "f1"] for v in kept.values()) and len(kept) == 6
    assert all(set(M.importances(m, d.names)) <= {"f0", "f1"} for m in models)


def test_search(data):
    _, _, d = data
    out = M.search(d, count=4, min_trees=2, max_trees=4, factor=2).toPandas()
    per = out.groupby(["symbol", "side", "trees"]).size().unstack()
    assert (per[2] == 4).all() and (per[4] == 2).all() and out.f1.between(0, 1).all()
    first = out[out.trees == 2].sort_values("rank").groupby(["symbol", "side"]).f1.apply(list)
    assert all(x == sorted(x, reverse=True) for x in first)
    # One candidate's score against fits by themselves.
    row = out[(out.symbol == "A") & (out.side == "BUY") & (out.trees == 2)].iloc[0]
    p = Params(int(row.depth), float(row.step), float(row.subsample))
    f1 = []
    for k in (1, 2, 3):
        m = R.grow(d.table, len(NAMES), [R.Spec("A", 0, p, k)], 2)
        at = R.score(d.table, len(NAMES), m).where(f"role = {R.TEST} and label is not null").toPandas()
        hit, wrong = ((at.label == 1) & (at.pred == 1)).sum(), (at.label != at.pred).sum()
        f1.append(2 * hit / (2 * hit + wrong) if hit else 0.0)
    assert np.mean(f1) == pytest.approx(row.f1)


def test_missing_cells_and_empty_tables(spark):
    bars, cells = make(spark)
    holes = cells.where("not (feature = 'f1' and hour(bar_ts) = 3)")
    d = M.inputs(holes, bars, 3600, NAMES)
    assert d.table.count() == 3 * N and all(m.value for m in M.train(d, 2, 0))
    none = M.inputs(cells.where("false"), bars.where("false"), 3600, NAMES)
    assert none.symbols == () and M.train(none, 2, 0) == []
