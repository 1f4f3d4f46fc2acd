"""Fitted parameters, bars with gaps, and positions in several rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import fitted as P
from barloom.operators import quotes as Q
from barloom.operators import transforms as T

N = 90


def make(spark):
    r = np.random.default_rng(7)
    parts = []
    for s, f in (("A", "x"), ("A", "y"), ("B", "x")):
        v = 5 + 0.1 * np.arange(N) + r.standard_normal(N)
        v[[3, 40]] = np.nan
        parts.append(pd.DataFrame({"symbol": s, "feature": f, "bar_ts": pd.date_range("2024-01-01", periods=N, freq="h"), "value": v}))
    pdf = pd.concat(parts)
    return pdf, spark.createDataFrame(pdf).withColumn("value", F.nanvl("value", F.lit(None)))


FITS = {
    "detrended": (lambda d: P.fit_lines(d, 3600), lambda d, p, n: P.detrend(d, p, 3600, n)),
    "zscore": (P.fit_moments, lambda d, p, n: P.zscore(d, p, 3600, n)),
    "norm": (P.fit_range, lambda d, p, n: P.minmax(d, p, 3600, n)),
    "winsorized": (P.fit_limits, lambda d, p, n: P.winsorize(d, p, 3600, n)),
}


def expected(name, train, v):
    t = train[~np.isnan(train)]
    if name == "detrended":
        b, a = np.polyfit(np.flatnonzero(~np.isnan(train)), t, 1)
        return v - (a + b * np.arange(len(v)))
    if name == "zscore":
        return (v - t.mean()) / t.std()
    if name == "norm":
        return 2 * (v - t.min()) / (t.max() - t.min()) - 1
    cut, s = int(0.1 * len(t)), np.sort(t)
    return np.where(np.isnan(v), np.nan, np.clip(v, s[cut], s[len(t) - cut - 1]))


@pytest.mark.parametrize("name", FITS)
def test_fit_on_training_rows(spark, name):
    """Parameters come from the training rows alone: other test rows change no parameter and no other row."""
    pdf, df = make(spark)
    fit, apply = FITS[name]
    late = F.col("bar_ts") >= F.lit("2024-01-03 00:00:00").cast("timestamp")
    train = df.where(~late)
    got = apply(df, fit(train), 16).toPandas().sort_values(["symbol", "feature", "bar_ts"])
    for (s, f), g in got.groupby(["symbol", "feature"]):
        v = pdf[(pdf.symbol == s) & (pdf.feature == f)].value.to_numpy()
        assert np.allclose(g[name].to_numpy(dtype=float), expected(name, v[:48], v), equal_nan=True)
    wild = df.withColumn("value", F.when(late, F.col("value") * 1000).otherwise(F.col("value")))
    again = apply(wild, fit(wild.where(~late)), 16).where(~late).select(*got.columns).toPandas().sort_values(["symbol", "feature", "bar_ts"])
    assert np.allclose(again[name].astype(float), got[got.bar_ts < "2024-01-03"][name].astype(float), equal_nan=True)
    assert apply(df.where("symbol = 'B'"), fit(train.where("symbol = 'A'")), 16).where(f"{name} is not null").count() == 0
    assert apply(df.where("false"), fit(train), 16).count() == 0


def test_bars_with_gaps(spark):
    """Block lengths do not matter when bars are missing, and neighbours are the rows that exist."""
    pdf, df = make(spark)
    sparse = df.where("minute(bar_ts) = 0 and pmod(hour(bar_ts), 3) <> 1 and (day(bar_ts) <> 2)").na.fill(5.0)
    want = sparse.toPandas().sort_values(["symbol", "feature", "bar_ts"])
    by = want.groupby(["symbol", "feature"]).value
    for op, out, plain in (
        (T.lag_diff, "diff", by.diff()),
        (T.col_smooth, "smooth", by.rolling(5).mean().reset_index(level=[0, 1], drop=True)),
    ):
        for rows in (4, 4096):
            got = op(sparse, 3600, rows=rows, gaps=True).toPandas().sort_values(["symbol", "feature", "bar_ts"])
            assert np.allclose(got[out].astype(float), plain.to_numpy(), equal_nan=True), (out, rows)
    short, long = (T.col_savgol(sparse, 3600, rows=n, gaps=True).toPandas().sort_values(["symbol", "feature", "bar_ts"]) for n in (4, 4096))
    assert np.allclose(short["savgol"].astype(float), long["savgol"].astype(float), equal_nan=True)


def test_positions_in_several_rows(spark):
    bars = spark.createDataFrame([("A", 1.0), ("B", 2.0), ("C", 3.0)], "symbol string, close double")
    held = spark.createDataFrame([("A", 3.0), ("A", -5.0), ("B", 7.0)], "symbol string, qty double")
    rules = spark.createDataFrame([("B", "index"), ("B", "other")], "symbol string, rule string")
    got = {r.symbol: (r.inventory, r.gamma) for r in Q.gamma(Q.inventory(bars, held), held, rules).collect()}
    assert got == {"A": (-2.0, 0.002), "B": (7.0, pytest.approx(0.07)), "C": (1.0, pytest.approx(0.007))}
