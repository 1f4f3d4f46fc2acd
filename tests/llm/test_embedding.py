"""Embedding near-dedup against all pairs."""

import numpy as np
import pytest

from barloom.llm.embedding_dedup import near_duplicates


def brute(ids, x, threshold=0.9):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= threshold
    np.fill_diagonal(link, False)
    label = np.array(ids)
    while True:
        new = np.array([min([label[k], *label[link[k]]]) for k in range(len(ids))])
        if (new == label).all():
            return {i: (int(link[k].sum()), int(label[k])) for k, i in enumerate(ids)}, link
        label = new


def planted(n=600, d=32, seed=3):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, d))
    x[100:140] = x[0] + 0.05 * r.standard_normal((40, d))  # one tight group
    x[200:210] = x[1]  # copies
    for k in range(300, 400):  # pairs just above the threshold
        y, z = x[k - 290] / np.linalg.norm(x[k - 290]), r.standard_normal(d)
        z -= (z @ y) * y
        x[k] = 0.91 * y + np.sqrt(1 - 0.91**2) * z / np.linalg.norm(z)
    return x


def test_brute_force(spark):
    x = planted()
    ids = list(range(5, 5 + len(x)))
    df = spark.createDataFrame([(i, v.tolist(), i) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>, _rep long")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(df.repartition(4), recall=0.999).collect()}
    want, link = brute(ids, x)
    found = sum(n for n, _ in got.values()) / max(1, link.sum())
    assert all(got[i][0] <= want[i][0] for i in ids)
    assert found >= 0.99
    same = [got[i] == want[i] for i in ids]
    assert np.mean(same) > 0.98
    assert all(got[i] == want[i] for i in range(105, 145))


def test_recall_at_the_threshold(spark):
    """Measured recall of the default setting for pairs just above 0.9 (closer pairs fare better)."""
    r = np.random.default_rng(8)
    y = r.standard_normal((1500, 64))
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    z = r.standard_normal(y.shape)
    z -= (z * y).sum(1, keepdims=True) * y
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    x = np.concatenate([y, 0.905 * y + np.sqrt(1 - 0.905**2) * z])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = near_duplicates(df).where("n_links > 0").count()
    assert got / len(x) >= 0.95


@pytest.mark.parametrize("common", [0.5, 0.7, 0.8])
def test_recall_with_a_strong_mean(spark, common):
    """Pairs just above 0.9 among vectors whose cosines are all about `common`."""
    r = np.random.default_rng(5)
    n, d = 1000, 64
    u, z = r.standard_normal((2, n, d))
    u[:, 0] = z[:, 0] = 0
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    z -= (z * u).sum(1, keepdims=True) * u
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    c = (0.905 - common) / (1 - common)
    x = np.sqrt(1 - common) * np.concatenate([u, c * u + np.sqrt(1 - c * c) * z])
    x[:, 0] = np.sqrt(common)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = (x @ x.T >= 0.9).sum() - len(x)
    got = near_duplicates(df).selectExpr("sum(n_links)").first()[0]
    assert 0.95 * want <= got <= want


@pytest.mark.parametrize("kind", ["float", "double"])
def test_odd_rows(spark, kind):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [None, 1.0]),
            (7, [inf, 1.0]), (8, []), (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in near_duplicates(df, recall=0.9999).collect() if r.vec_id)
    alone = [(k, 0, k, True) for k in (3, 4, 5, 6, 7, 8, 9, 10)]
    assert got == [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), *alone]
    assert near_duplicates(df.where("vec_id > 99")).count() == 0
    assert near_duplicates(df).count() == len(rows)
