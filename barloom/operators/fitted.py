"""Detrending and scaling with parameters fitted on some rows and applied to any.

The forms in transforms.py see whole series, later rows included. Here a fit gives a small table by
(symbol, feature), from the training rows say, and the application reads that table alone, so rows
it was not fitted on change nothing. Parameters reach the cells block by block (see frames.py): a
series is never one task. Series without a fitted row have null results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.numeric import div
from barloom.operators.frames import BLOCK_ROWS, Frame, grid_index
from barloom.operators.orderstats import order_statistics
from barloom.operators.transforms import KEYS, ROUNDING, limit_ranks


def _with(long: DataFrame, params: DataFrame, period: float, rows: int) -> Frame:
    """Cells with their series' parameters."""
    f = Frame.of(long, period, keys=KEYS, rows=rows)
    return f.carry_with({"_t": F.count(F.lit(1))}, lambda part: part.drop("_t").join(params, list(KEYS)))


def fit_lines(long: DataFrame, period: float) -> DataFrame:
    """(symbol, feature, my, mx, slope): straight line of the value over the bar's place on the grid; slope 0 for one bar."""
    i = grid_index("bar_ts", period).cast("double")
    x = F.when(F.col("value").isNotNull(), i)
    fit = long.groupBy(*KEYS).agg(F.avg("value").alias("my"), F.avg(x).alias("mx"), F.regr_slope("value", x).alias("slope"))
    return fit.withColumn("slope", F.coalesce("slope", F.lit(0.0)))


def detrend(long: DataFrame, lines: DataFrame, period: float, rows: int = BLOCK_ROWS) -> DataFrame:
    """value minus its line; what rounding leaves on the line is 0."""
    f = _with(long, lines, period, rows).add(_rise=F.col("slope") * (F.col("_i") - F.col("mx")))
    left = F.col("value") - (F.col("my") + F.col("_rise"))
    noise = F.abs(left) <= ROUNDING * F.greatest(F.abs("value"), F.abs("my") + F.abs("_rise"))
    return f.add(detrended=F.when(noise, 0.0).otherwise(left)).drop("my", "mx", "slope", "_rise").own()


def fit_moments(long: DataFrame) -> DataFrame:
    """(symbol, feature, mean, deviation): population deviation, exactly 0 where all values are equal."""
    flat = F.min("value") == F.max("value")
    return long.groupBy(*KEYS).agg(F.avg("value").alias("mean"), F.when(flat, 0.0).otherwise(F.stddev_pop("value")).alias("deviation"))


def zscore(long: DataFrame, moments: DataFrame, period: float, rows: int = BLOCK_ROWS) -> DataFrame:
    f = _with(long, moments, period, rows)
    return f.add(zscore=div(F.col("value") - F.col("mean"), "deviation")).drop("mean", "deviation").own()


def fit_range(long: DataFrame) -> DataFrame:
    return long.groupBy(*KEYS).agg(F.min("value").alias("least"), F.max("value").alias("most"))


def minmax(long: DataFrame, ranges: DataFrame, period: float, rows: int = BLOCK_ROWS) -> DataFrame:
    """Scaled so that the fitted range is -1..1; values beyond it lie outside."""
    f = _with(long, ranges, period, rows)
    scaled = 2 * div(F.col("value") - F.col("least"), F.col("most") - F.col("least")) - 1
    return f.add(norm=scaled).drop("least", "most").own()


def fit_limits(long: DataFrame, p: float = 0.10) -> DataFrame:
    """(symbol, feature, low, high): the values between which a share p is cut off at either end."""
    counts = long.groupBy(*KEYS).agg(F.count("value").alias("n"))
    limits = order_statistics(long, KEYS, "value", limit_ranks(counts, p))
    return limits.groupBy(*KEYS).pivot("name", ["low", "high"]).agg(F.first("value"))


def winsorize(long: DataFrame, limits: DataFrame, period: float, rows: int = BLOCK_ROWS) -> DataFrame:
    f = _with(long, limits, period, rows)
    clamped = F.when(F.col("value").isNotNull(), F.least(F.greatest(F.col("value"), F.col("low")), F.col("high")))
    return f.add(winsorized=F.when(F.col("low").isNotNull(), clamped)).drop("low", "high").own()
