"""Next-price scenarios under geometric Brownian motion."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions import rolling as R
from barloom.functions.numeric import finite, sanitize
from barloom.operators.bars import last_bars
from barloom.operators.features import f_variance
from barloom.operators.frames import BLOCK_ROWS, Frame

YEARLY_RATE = 0.05375
Z95 = 1.6448536269514722


def step_rate(period: float) -> float:
    """Riskless rate per bar: 420 minutes a day, 252 days a year."""
    return YEARLY_RATE / ((60.0 / period) * 420 * 252)


def drift_and_vol(df: DataFrame, period: float, rows: int = BLOCK_ROWS, after: int = 0) -> Frame:
    """10-bar means of close returns and of the variance, for every bar."""
    f = Frame.of(df, period, before=8 + 9, after=after, rows=rows)
    f = f_variance.stage(f).put(variance=sanitize("variance"))
    f = f.pct_change(9, _return=F.col("close"))
    return f.roll(drift=R.mean("_return", 10), vol=R.mean("variance", 10)).drop("_return")


def params(df: DataFrame, period: float, rows: int = BLOCK_ROWS) -> DataFrame:
    """Parameters of each symbol's next step."""
    last = last_bars(drift_and_vol(df, period, rows).own(), 1)
    rate = step_rate(period)
    return last.select(
        "symbol", "bar_ts", F.col("close").alias("s0"), "drift", "vol",
        F.lit(rate).alias("rate"), F.lit(math.exp(-rate)).alias("discount"),
    )


def terminal_stats(p: DataFrame) -> DataFrame:
    """Mean, deviation and 5/50/95 % points of the next price in closed form."""
    s0, mu, v = F.col("s0"), F.col("drift"), F.col("vol")
    at = lambda z: finite(s0 * F.exp(mu - v * v / 2 + v * z))
    mean = finite(s0 * F.exp(mu))
    return p.select(
        "symbol", mean.alias("mean"), finite(mean * F.sqrt(F.exp(v * v) - 1)).alias("std"),
        at(-Z95).alias("p05"), at(0.0).alias("p50"), at(Z95).alias("p95"),
    )


def error(df: DataFrame, period: float, rows: int = BLOCK_ROWS) -> DataFrame:
    """Mean squared error of the expected next close against the one that came."""
    f = Frame.of(df, period, before=1, after=1, rows=rows)
    f = f.add(_next=F.lead("close").over(f.w))
    ahead = f.own("symbol", "bar_ts", "close", "open", "_next")
    g = drift_and_vol(ahead, period, rows)
    miss = finite(F.col("close") * F.exp("drift")) - F.col("_next")
    return g.own().groupBy("symbol").agg(F.avg(miss * miss).alias("mse"), F.count(miss).alias("bars"))
