"""Decay fits against known rates and against a plain search."""

import math

import numpy as np
import pytest

from barloom.operators import quotes as Q


def orders(spark, rows):
    return spark.createDataFrame([(s, float(x), float(d)) for s, x, d in rows], "symbol string, offset double, duration double")


@pytest.mark.parametrize("offset", [False, True])
def test_known_rates(spark, offset):
    """Rates of either sign, tiny, large and 0 come back to six digits; units of the distance do not matter."""
    rates = {"small": 0.02, "negative": -0.02, "five": 5.0, "steep": 3000.0, "units": 2e-7, "minus": -40.0}
    widths = {"steep": 0.004, "units": 3e7, "minus": 0.3}
    rows = []
    for s, k in rates.items():
        for x in np.linspace(0.0, widths.get(s, 1.0), 12) + widths.get(s, 1.0) / 7:
            rows += [(s, x, 50 * np.exp(-k * x) + (7 if offset else 0))] * 3
    rows += [("level", x, 9.0) for x in (1, 2, 3, 4)] if not offset else []
    got = {r.symbol: r for r in Q.decay_fit(orders(spark, rows), offset=offset).collect()}
    for s, k in rates.items():
        assert got[s].kappa == pytest.approx(k, rel=1e-6), s
        assert got[s].a == pytest.approx(50, rel=1e-5) and got[s].sse < 1e-6, s
        assert not offset or got[s].c == pytest.approx(7, rel=1e-4)
    if not offset:
        assert got["level"].kappa == pytest.approx(0, abs=1e-9) and got["level"].a == pytest.approx(9)


def plain(x, d, offset):
    """Least error over a fine grid of rates in units of the span, both signs."""
    u, best = (x - x.min()) / (x.max() - x.min()), np.inf
    for k in np.concatenate([[1e-9], np.geomspace(1e-3, 300, 4000), -np.geomspace(1e-3, 300, 4000)]):
        m = np.stack([np.exp(-k * (u - (k < 0)))] + ([np.ones(len(u))] if offset else []), 1)
        fit, *_ = np.linalg.lstsq(m, d, rcond=None)
        best = min(best, ((d - m @ fit) ** 2).sum())
    return best


@pytest.mark.parametrize("offset", [False, True])
def test_noisy_orders(spark, offset):
    r, rows, data = np.random.default_rng(4), [], {}
    for k, true in enumerate((0.4, 3.0, -2.0, 15.0)):
        x = r.integers(1, 9, 80) / 10
        d = np.maximum(0, 20 * np.exp(-true * x) + 3 + r.normal(0, 1.5, 80))
        data[f"s{k}"] = (x, d)
        rows += [(f"s{k}", a, b) for a, b in zip(x, d, strict=True)]
    got = {r.symbol: r for r in Q.decay_fit(orders(spark, rows), offset=offset).collect()}
    for s, (x, d) in data.items():
        assert got[s].sse <= plain(x, d, offset) * (1 + 1e-9)
        fit = got[s].a * np.exp(-got[s].kappa * x) + (got[s].c if offset else 0)
        assert got[s].sse == pytest.approx(((d - fit) ** 2).sum(), rel=1e-8)


def test_undetermined(spark):
    rows = [("one", 1, 4), ("one", 1, 6), ("zero", 1, 0), ("zero", 2, 0), ("zero", 3, 0)]
    rows += [("far", 1, 5), ("far", 2, 0), ("far", 3, 0), ("line", 1, 3), ("line", 2, 2), ("line", 3, 1)]
    got = {r.symbol: r for r in Q.decay_fit(orders(spark, rows)).collect()}
    assert (got["one"].kappa, got["one"].a, got["one"].sse) == (0.0, 5.0, 2.0)
    assert (got["zero"].kappa, got["zero"].a, got["zero"].sse) == (0.0, 0.0, 0.0)
    assert got["far"].kappa > 10 and got["far"].a * np.exp(-got["far"].kappa) == pytest.approx(5) and got["far"].sse == 0
    with_offset = {r.symbol: r for r in Q.decay_fit(orders(spark, rows), offset=True).collect()}
    assert "one" not in with_offset and abs(with_offset["line"].kappa) < 1e-6 and with_offset["line"].sse < 1e-9
    assert Q.decay_fit(orders(spark, rows).where("false")).count() == 0


def exact(x, n, d, kappa):
    """kappa and a where the slope of the error with offset is 0 next to a given rate, in fifty digits."""
    from decimal import Decimal as D
    from decimal import localcontext

    with localcontext(prec=50):
        x, n, d = ([D(v) for v in values] for values in (x, n, d))
        dot = lambda *cols: sum(math.prod(row) for row in zip(*cols, strict=True))

        def parts(k):
            e = [(-k * v).exp() for v in x]
            g = [-v * w for v, w in zip(x, e, strict=True)]
            fit = dot(d, e) - sum(d) * dot(n, e) / sum(n), dot(n, e, e) - dot(n, e) ** 2 / sum(n)
            slope = dot(d, g) - sum(d) * dot(n, g) / sum(n), dot(n, e, g) - dot(n, e) * dot(n, g) / sum(n)
            return slope[0] * fit[1] - fit[0] * slope[1], fit[0] / fit[1]

        k0 = D(kappa)
        k1, f0 = k0 * (1 + D("1e-7")), parts(k0)[0]
        while abs(k1 - k0) > abs(k1) * D("1e-30"):
            f1 = parts(k1)[0]
            k0, k1, f0 = k1, k1 - f1 * (k1 - k0) / (f1 - f0), f1
        return float(k1), float(parts(k1)[1])


def test_digits_of_weak_trends(spark):
    """Long durations that hardly go with the distance: rates and levels have eleven digits all the same."""
    r, rows, data = np.random.default_rng(7), [], {}
    for k in range(40):
        d = 20_000_000_000 + r.integers(0, 200_000_000, (7, 30))
        data[f"s{k}"] = d
        rows += [(f"s{k}", (i + 1) / 100, v) for i in range(7) for v in d[i]]
    got, seen = Q.decay_fit(orders(spark, rows), offset=True).collect(), 0
    for g in got:
        if not 0.1 < abs(g.kappa) < 700:  # the others' error falls for ever, or they are lines
            continue
        seen += 1
        kappa, a = exact([(i + 1) / 100 for i in range(7)], [30] * 7, data[g.symbol].sum(1).tolist(), g.kappa)
        assert g.kappa == pytest.approx(kappa, rel=1e-11) and g.a == pytest.approx(a, rel=1e-11), g.symbol
    assert seen > 10


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("offset", [False, True])
def test_symbols_are_not_broadcast(spark, monkeypatch, offset):
    """No plan brings a row per symbol through the driver where they are many, and symbols dealt into parts come out right."""
    rates, rows = {f"s{k}": (0.5 + k % 5) * (-1) ** k for k in range(30)}, []
    for s, k in rates.items():
        x = np.arange(1, 5 + int(abs(k))) / 10
        rows += [(s, v, 20 * np.exp(-k * v) + (3 if offset else 0)) for v in x]
    rows += [("far", 1, 5), ("far", 2, 0), ("far", 3, 0), ("one", 1, 4), (None, 1, 2), (None, 2, 1), (None, 3, 4)]
    plans, write = [], Q.materialize
    monkeypatch.setattr(Q, "materialize", lambda df, label: plans.append((label, planned(df))) or write(df, label))
    monkeypatch.setattr(Q, "FEW", 0, raising=False)
    monkeypatch.setattr(Q, "PART", 3, raising=False)
    fit = Q.decay_fit(orders(spark, rows), offset=offset)
    plans.append(("fit", planned(fit)))
    assert [label for label, plan in plans if "Broadcast" in plan] == []
    got = {g.symbol: g for g in fit.collect()}
    assert got.keys() == rates.keys() | {"far"} | (set() if offset else {"one"})
    for s, k in rates.items():
        assert got[s].kappa == pytest.approx(k, rel=1e-6) and got[s].a == pytest.approx(20, rel=1e-5) and got[s].sse < 1e-6, s
    assert got["far"].kappa > 10 and got["far"].sse == 0
    assert offset or (got["one"].kappa, got["one"].a, got["one"].sse) == (0.0, 4.0, 0.0)
