"""Embedding whitening against a dense eigensolver, and the small solver on hard matrices."""

import numpy as np
import pytest

from barloom.llm import bidiagonal, whitening

R = np.random.default_rng(5)


def orthogonal(n):
    return np.linalg.qr(R.standard_normal((n, n)))[0]


def wilkinson(n=101):
    return np.linalg.cholesky(np.diag(np.abs(np.arange(n) - 50.0) + 60) + np.diag(np.ones(n - 1), 1) + np.diag(np.ones(n - 1), -1)).T


HARD = {
    "plain": R.standard_normal((300, 48)), "graded": R.standard_normal((300, 48)) * 0.6 ** np.arange(48), "rank 9": R.standard_normal((90, 9)) @ R.standard_normal((9, 48)),
    "zero": np.zeros((5, 7)), "equal rows": np.ones((50, 12)), "wide": R.standard_normal((6, 20)), "one column": R.standard_normal((30, 1)), "identity": np.eye(40),
    "ties": np.linalg.qr(R.standard_normal((200, 40)))[0] * np.repeat([3.0, 2.0, 1.0, 1e-3], 10) @ orthogonal(40), "wilkinson": wilkinson(),
    "near ties": np.linalg.qr(R.standard_normal((200, 40)))[0] * (1 + np.repeat([0, 1e-13, 1e-10, 1e-6], 10)) @ orthogonal(40),
    "columns twice": np.repeat(R.standard_normal((100, 20)), 2, axis=1),
}


@pytest.mark.parametrize("name", HARD)
def test_solver(name):
    x = HARD[name]
    lam, v = bidiagonal.right_singular(np.linalg.qr(x, mode="r"), 32)
    want = np.zeros(x.shape[1])
    s = np.linalg.svd(x, compute_uv=False) ** 2
    want[: len(s)] = s
    top = max(want[0], 1e-300)
    assert np.abs(lam - want).max() <= 1e-13 * top
    assert np.abs(v.T @ v - np.eye(v.shape[1])).max() <= 1e-13
    assert np.abs(x.T @ (x @ v) - v * lam[: v.shape[1]]).max() <= 1e-12 * top


def small_values_are_accurate():
    a, b = 10.0 ** -np.arange(12), 0.5 * 10.0 ** -np.arange(11)
    lam = bidiagonal.dqds(a * a, b * b)
    return np.sqrt(lam[0]) / (np.prod(a) / np.prod(np.sqrt(lam[1:])))


def test_small_values_to_full_relative_accuracy():
    assert small_values_are_accurate() == pytest.approx(1.0, abs=1e-13)


def brute(x):
    n, s = len(x), x.sum(0)
    c = (n * x - s) / n
    e, w = np.linalg.eigh(c.T @ c / n)
    return [int(sum(int(v) ** 2 for v in row)) for row in n * x - s], e[::-1], c @ w[:, ::-1] / np.sqrt(np.maximum(e[::-1], 1e-300))


def test_brute_force(spark):
    x = R.standard_normal((700, 40)) * np.linspace(3, 0.5, 40) + 0.3
    rows = [(k, v.tolist(), k, "x") for k, v in enumerate(x)]
    odd = [(None, x[0].tolist(), 1, "x"), (5, x[5].tolist(), 1, "x"), (800, None, 1, "x"), (801, [None] * 40, 1, "x"), (802, [float("nan")] * 40, 1, "x")]
    odd += [(803, [float("inf")] + [0.0] * 39, 1, "x"), (804, [], 1, "x"), (805, [1.0, 2.0], 1, "x")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, component int, _key string").repartition(37)
    got = whitening.whiten(df).toPandas()
    used = np.concatenate([x, x[:1], x[5:6]])
    grid = np.floor(64 * used).astype(np.int64) + 1000000
    dev, e, white = brute(grid)
    assert len(got) == 32 * len(used) and (got.n == len(used)).all()
    table = got[got.vec_id.notna()].drop_duplicates(["vec_id", "component"]).sort_values(["vec_id", "component"])
    y = table.whitened.to_numpy().reshape(700, 32)
    y = y * np.sign((y * white[:700, :32]).sum(0))
    assert np.abs(y - white[:700, :32]).max() < 1e-9
    assert [int(v) for v in table.deviation.iloc[::32]] == dev[:700]
    assert np.allclose(table.explained[:32], e[:32] / e.sum(), rtol=1e-12) and (got.identity_error <= 1e-10).all()


def test_edges(spark):
    make = lambda rows: spark.createDataFrame([(k, v) for k, v in enumerate(rows)], "vec_id long, embedding array<float>")
    assert whitening.whiten(make([[1.0]]).where("false")).count() == 0
    assert whitening.whiten(make([None, [], [float("nan")]])).count() == 0
    one = whitening.whiten(make([[1.0, 2.0, 3.0]])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained) for r in one] == [(k, 1, 0, None, None) for k in (1, 2, 3)]
    few = whitening.whiten(make([[1.0, 2.0, 3.0], [2.0, 4.0, 7.0], [2.0, 4.0, 7.0]])).collect()
    assert [r.whitened is None for r in few[:3]] == [False, True, True] and few[0].identity_error < 1e-12
    assert few[0].explained == pytest.approx(1.0) and len(few) == 9
    tie = whitening.whiten(make([[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0], [0.0, -1.0]])).collect()
    assert tie[0].identity_error < 1e-12 and {r.deviation for r in tie} == {4**2 * 64**2}


def test_exact_deviation_beyond_long():
    t = whitening.Totals(2, 3_000_000_000, (3_000_000_000 * 1_000_000 + 1, 5))
    x = np.array([[1_000_064, -7], [1_000_000_000_000, 1 << 40]])
    want = [sum((t.n * int(v) - s) ** 2 for v, s in zip(row, t.sums, strict=True)) for row in x]
    assert [int(d) for d in t.deviations(x)] == want
