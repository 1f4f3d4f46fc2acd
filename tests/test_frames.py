"""Blocked operators against pandas over whole series, with blocks far shorter than the series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import rolling as R
from barloom.operators import bars as B
from barloom.operators import features as A
from barloom.operators import transforms as T
from barloom.operators.frames import Frame
from barloom.operators.orderstats import order_statistics
from barloom.operators.rsi import rsi

HOUR = 3600


def series(n=150, symbols=("A", "B"), seed=1, gaps=True):
    """A symbol with many bars, a shorter one, and one with a single bar."""
    rng = np.random.default_rng(seed)
    frames = []
    for k, s in enumerate([*symbols, "ONE"]):
        m = 1 if s == "ONE" else n - 40 * k
        ts = pd.date_range("2024-01-01 05:00", periods=m, freq="h")
        price = np.round(rng.lognormal(3, 0.5, m), 2)
        if gaps and m > 60:
            price[20:45] = price[20]  # a stretch without any change
            price[50] = 0.0
        frames.append(
            pd.DataFrame(
                {"symbol": s, "bar_ts": ts, "open": price, "high": price + 1, "low": price / 2, "close": price[::-1],
                 "volume": np.round(rng.integers(0, 90, m)).astype(float)}
            )
        )
    return pd.concat(frames, ignore_index=True)


def collected(df):
    return df.toPandas().sort_values(["symbol", "bar_ts"]).reset_index(drop=True)


def by_symbol(pdf, fn):
    return pd.concat([fn(g) for _, g in pdf.sort_values(["symbol", "bar_ts"]).groupby("symbol")]).to_numpy()


def close(a, b):
    np.testing.assert_allclose(np.asarray(a, float), np.asarray(b, float), rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("rows", [7, 64, 2048])
def test_rolling_equals_pandas(spark, rows):
    pdf = series()
    f = Frame.of(spark.createDataFrame(pdf), HOUR, before=24, rows=rows)
    got = collected(f.roll(m=R.mean("open", 5), s=R.std("open", 25), p=R.std_pop("open", 5), t=R.total("close", 10)).own())
    close(got.m, by_symbol(pdf, lambda g: g.open.rolling(5).mean()))
    close(got.s, by_symbol(pdf, lambda g: g.open.rolling(25).std()))
    close(got.p, by_symbol(pdf, lambda g: g.open.rolling(5).std(ddof=0)))
    close(got.t, by_symbol(pdf, lambda g: g.close.rolling(10).sum()))
    assert len(got) == len(pdf)


@pytest.mark.parametrize("rows", [7, 2048])
def test_running_sum_and_change_skip_gaps(spark, rows):
    pdf = series()
    pdf.loc[pdf.index % 11 < 4, "open"] = np.nan
    pdf.loc[3:30, "open"] = np.nan  # longer than some blocks
    f = Frame.of(spark.createDataFrame(pdf).withColumn("open", F.nanvl("open", F.lit(None))), HOUR, rows=rows)
    got = collected(f.running(sums={"s": F.col("open")}, changes={"c": F.col("open")}).own())
    close(got.s, by_symbol(pdf, lambda g: g.open.cumsum()))
    want = by_symbol(pdf, lambda g: g.open.ffill() / g.open.ffill().shift() - 1)
    close(got.c, np.where(np.isfinite(want), want, np.nan))


def test_positions_and_ranges_with_one_hot_symbol(spark):
    n = 3000
    df = spark.range(n).select(
        F.when(F.col("id") % 10 < 8, "HOT").otherwise("COLD").alias("symbol"),
        F.lit(0).cast("timestamp").alias("ts"),  # one single instant
        F.col("id").alias("seq"), (F.col("id") % 7).cast("double").alias("price"), F.lit(2.0).alias("size"),
    )
    f = Frame.ranged(df, ["symbol"], ["ts", "seq"], parts=6)
    assert f.df.groupBy("_b").count().agg(F.max("count")).first()[0] < n / 3  # the instant is split
    got = f.positions().own().toPandas().sort_values(["symbol", "seq"])
    assert (got.groupby("symbol").cumcount() == got.pos).all()
    ticks = B.vwap_trade(df, parts=6).toPandas().sort_values(["symbol", "seq"])
    want = ticks.groupby("symbol").price.expanding().mean().to_numpy()
    close(ticks.d_vwap, want)


def wilder(x, n):
    """The recurrence, one value after the other."""
    d = np.append([0.0], np.diff(x))
    out = np.full(len(x), np.nan)
    gain, loss = d[1 : n + 1].clip(min=0).sum() / n, -d[1 : n + 1].clip(max=0).sum() / n
    for i in range(n + 1, len(x)):
        gain, loss = (gain * (n - 1) + max(d[i], 0)) / n, (loss * (n - 1) + max(-d[i], 0)) / n
        out[i] = 100 if loss == 0 else 100 - 100 / (1 + gain / loss)
    return pd.Series(out)


@pytest.mark.parametrize("n,rows", [(5, 6), (14, 30), (14, None), (5, 50)])
def test_rsi_blocks_equal_recurrence(spark, n, rows):
    pdf = series()
    got = collected(rsi(spark.createDataFrame(pdf), HOUR, ["open", "close"], n=n, rows=rows))
    for c in ("open", "close"):
        want = by_symbol(pdf, lambda g: wilder(g[c].to_numpy(), n))
        close(got[f"rsi_{c}"], want)
    assert got.rsi_open.dropna().between(0, 100).all()


def test_rsi_constant_rising_falling_short(spark):
    ts = pd.date_range("2024-01-01", periods=20, freq="h")
    make = lambda s, v: pd.DataFrame({"symbol": s, "bar_ts": ts[: len(v)], "x": v})
    pdf = pd.concat(
        [make("CONST", [5.0] * 20), make("UP", list(np.arange(20.0))), make("DOWN", list(-np.arange(20.0))), make("SHORT", [1.0, 2.0, 1.0])]
    )
    got = collected(rsi(spark.createDataFrame(pdf), HOUR, ["x"], n=5, rows=8))
    last = got.groupby("symbol").rsi_x.last()
    assert last["CONST"] == 100 and last["UP"] == 100 and last["DOWN"] == 0
    assert got[got.symbol == "SHORT"].rsi_x.isna().all()


def long_form(spark, pdf):
    return T.to_long(spark.createDataFrame(pdf), ["open", "volume"])


def cell_values(df, column, feature="open"):
    return collected(df.filter(F.col("feature") == feature))[column]


def test_savgol_edges_are_cubic_fits(spark):
    pdf = series(gaps=False)
    got = cell_values(T.col_savgol(long_form(spark, pdf), HOUR, rows=9), "savgol")

    def smooth(g):
        x, out = g.open.to_numpy(), np.full(len(g), np.nan)
        for i in range(len(x) if len(x) >= 5 else 0):
            s = min(max(i - 2, 0), len(x) - 5)
            out[i] = np.polyval(np.polyfit(np.arange(5), x[s : s + 5], 3), i - s)
        return pd.Series(out)

    np.testing.assert_allclose(got, by_symbol(pdf, smooth), rtol=1e-7)


def test_detrend_and_expanding_zscore(spark):
    pdf = series()
    long = long_form(spark, pdf)
    got = cell_values(T.col_detrend(long, HOUR, rows=9), "detrended")

    def flat(g):
        x = np.arange(len(g))
        fit = np.polyval(np.polyfit(x, g.open, 1), x) if len(g) > 1 else g.open
        return pd.Series(g.open.to_numpy() - fit)

    np.testing.assert_allclose(got, by_symbol(pdf, flat), rtol=1e-7, atol=1e-8)
    got = cell_values(T.zscore_expanding(long, HOUR, rows=9), "zscore")

    def score(g):
        x = np.log(g.open.where(g.open > 0))
        z = ((x - x.expanding().mean()) / x.expanding().std()).ffill()
        return z / z.shift() - 1

    np.testing.assert_allclose(got, by_symbol(pdf, score), rtol=1e-6, atol=1e-9)


def test_order_statistics_with_ties_and_signs(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(0, 1e-3, 400), rng.normal(0, 1e6, 300), np.full(500, 1e-7), np.zeros(50), [-1e300, 1e300]])
    df = spark.createDataFrame(pd.DataFrame({"g": 0, "v": v}))
    ranks = [1, 2, 37, 400, 600, 601, 900, 1100, len(v)]
    wanted = spark.createDataFrame([(0, str(r), r) for r in ranks], "g int, name string, rank long")
    got = {int(r["name"]): r["v"] for r in order_statistics(df.withColumn("g", F.col("g").cast("int")), ["g"], "v", wanted).collect()}
    assert got == {r: np.sort(v)[r - 1] for r in ranks}


def test_winsorize_clamps_all_cells_together(spark):
    pdf = series()
    long = long_form(spark, pdf)
    got = T.winsorize_global(long, 0.1).toPandas()
    x = np.sort(got.value)
    cut = int(0.1 * len(x))
    close(got.winsorized, got.value.clip(x[cut], x[len(x) - cut - 1]))


def test_results_do_not_depend_on_partitioning(spark):
    pdf = series()
    a = collected(A.f_last_return_roll(spark.createDataFrame(pdf).repartition(1), HOUR, rows=11))
    b = collected(A.f_last_return_roll(spark.createDataFrame(pdf).repartition(7), HOUR, rows=2000))
    close(a.last_return_10mu, b.last_return_10mu)


def test_base_table_equals_single_operators(spark):
    from barloom.operators import quotes as Q
    from barloom.plans import batch

    pdf = series()
    held = spark.createDataFrame([("A", 40.0), ("B", -7.0)], "symbol string, qty double")
    b = Q.gamma(Q.inventory(spark.createDataFrame(pdf), held), held)
    base = collected(batch.base_features(b, HOUR, rows=32))
    assert list(base.columns[2:]) == batch.BASE and not base.isna().any().any()
    single = {
        "Volatility4": A.f_vol_of_vol25, "Volatility3_mom": A.f_volatility_mom, "open_var_diff": A.f_var_band_diff,
        "mu": A.f_mu, "last_return_10_sum": A.f_last_return_roll, "OBV": A.f_obv, "market_impact": A.f_market_impact,
    }
    for column, op in single.items():
        close(base[column], collected(op(b, HOUR))[column].fillna(1e-7))
    close(base.rsi_close, collected(rsi(b, HOUR, ["close"], n=5)).rsi_close.fillna(1e-7))
    spreads = collected(Q.spread_drift(Q.quote_inputs(b, HOUR)))
    close(base.bid_spread_aysm2, spreads.bid_spread_aysm2.fillna(1e-7))
