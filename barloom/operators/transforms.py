"""Column transforms over the long form (symbol, feature, bar_ts, value).

One row per cell means that a transform of many hundred columns is one narrow window, which stays
inside generated code and spreads over (symbol, feature, block).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.functions import rolling as R
from barloom.functions import numeric as N
from barloom.operators.features import zscore_series
from barloom.operators.frames import BLOCK_ROWS, Frame
from barloom.operators.orderstats import order_statistics, quantile_ranks
from barloom.session import materialize

KEYS = ("symbol", "feature")
ROUNDING = 1e-12  # what is left of a value and its fit is rounding up to this share of the terms' size

# Least-squares weights of a cubic through five equally spaced points.
SAVGOL_MIDDLE = (-3, 12, 17, 12, -3)  # over 35, at the third point
SAVGOL_FIRST = (69, 4, -6, 4, -1)  # over 70, at the first point
SAVGOL_SECOND = (2, 27, 12, -8, 2)  # over 35, at the second point


def to_long(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Unpivot `columns`; the columns in `keep` stay beside each cell."""
    ids = ["symbol", "bar_ts"]
    extra = [F.col(c).alias(f"by_{c}") for c in keep]
    wide = df.select(*ids, *extra, *[F.col(c).cast("double").alias(c) for c in columns])
    return wide.unpivot([*ids, *[f"by_{c}" for c in keep]], list(columns), "feature", "value")


def to_wide(long: DataFrame, columns: Sequence[str]) -> DataFrame:
    return long.groupBy("symbol", "bar_ts").pivot("feature", list(columns)).agg(F.first("value"))


def _frame(long: DataFrame, period: float, before: int = 0, after: int = 0, rows: int = BLOCK_ROWS, gaps: bool = False) -> Frame:
    return Frame.of(long, period, before=before, after=after, keys=KEYS, rows=rows, gaps=gaps)


def sanitize(long: DataFrame, column: str = "value") -> DataFrame:
    return long.withColumn(column, N.sanitize(column))


def lag_diff(long: DataFrame, period: float, rows: int = BLOCK_ROWS, gaps: bool = False) -> DataFrame:
    """value minus the one before; `gaps` says that bars may be missing (see Frame.of)."""
    f = _frame(long, period, before=1, rows=rows, gaps=gaps)
    return f.add(diff=F.col("value") - F.lag("value").over(f.w)).own()


def pct_change(long: DataFrame, period: float, rows: int = BLOCK_ROWS) -> DataFrame:
    return _frame(long, period, rows=rows).pct_change(change=F.col("value")).own()


def col_div(long: DataFrame, by: str) -> DataFrame:
    """value divided by a column kept beside it (see to_long)."""
    return long.withColumn("ratio", N.div("value", f"by_{by}"))


def col_div_rolling(df: DataFrame, period: float, columns: Sequence[str], by: str = "Volatility", rows: int = BLOCK_ROWS) -> DataFrame:
    """Each column divided by the 5-bar mean of `by`; takes wide bars, so the mean is made once."""
    f = Frame.of(df, period, before=4, rows=rows)
    f = f.roll(_by5=R.mean(by, 5))
    long = to_long(f.own(), columns, keep=("_by5",))
    return long.select("symbol", "bar_ts", "feature", "value", N.div("value", "by__by5").alias("ratio"))


def col_smooth(long: DataFrame, period: float, n: int = 5, rows: int = BLOCK_ROWS, gaps: bool = False) -> DataFrame:
    """Rolling mean; 5 in the batch form, 10 in the live one. `gaps` says that bars may be missing (see Frame.of)."""
    f = _frame(long, period, before=n - 1, rows=rows, gaps=gaps)
    return f.roll(smooth=R.mean("value", n)).own()


def col_savgol(long: DataFrame, period: float, rows: int = BLOCK_ROWS, gaps: bool = False) -> DataFrame:
    """Savitzky-Golay smoothing, window 5, order 3. Looks two rows ahead, so not for live use.

    The first and last two rows take the value of the cubic through the first and last five rows.
    """
    return _savgol_stage(_frame(long, period, before=4, after=4, rows=rows, gaps=gaps)).own()


def _savgol_stage(f: Frame) -> Frame:
    at = lambda k, c="value": F.lead(c, k).over(f.w) if k > 0 else F.lag(c, -k).over(f.w) if k < 0 else F.col(c)
    there = lambda k: at(k, "_i").isNotNull()
    fit = lambda weights, over, start, step: sum(
        (F.lit(float(w)) * at(start + step * j) for j, w in enumerate(weights)), F.lit(0.0)
    ) / F.lit(float(over))
    value = (
        F.when(there(-2) & there(2), fit(SAVGOL_MIDDLE, 35, -2, 1))
        .when(~there(-1), fit(SAVGOL_FIRST, 70, 0, 1))
        .when(~there(-2) & there(3), fit(SAVGOL_SECOND, 35, -1, 1))
        .when(~there(1), fit(SAVGOL_FIRST, 70, 0, -1))
        .when(~there(2) & there(-3), fit(SAVGOL_SECOND, 35, 1, -1))
    )
    return f.add(savgol=value)


def expand_ratios(long: DataFrame, by: Sequence[str] = ("volume", "variance")) -> DataFrame:
    """Each cell with its ratios to the columns kept beside it, in one pass and cleaned."""
    variants = [F.struct(F.col("feature").alias("f"), F.col("value").alias("v"))] + [
        F.struct(F.concat("feature", F.lit(f"_div_{c}")).alias("f"), N.div("value", f"by_{c}").alias("v")) for c in by
    ]
    return long.select("symbol", "bar_ts", F.explode(F.array(*variants)).alias("x")).select(
        "symbol", "bar_ts", F.col("x.f").alias("feature"), N.sanitize(F.col("x.v")).alias("value")
    )


def expand_smooth(long: DataFrame, period: float, rows: int = BLOCK_ROWS, live: bool = False) -> DataFrame:
    """Each cell with its smoothed value and its change (batch), or its 10-bar mean (live), cleaned.

    All variants of a cell come from the same frame, so the long table is shuffled once.
    """
    if live:
        f = _frame(long, period, before=9, rows=rows)
        f = f.roll(smooth_10=R.mean("value", 10))
        names = ("smooth_10",)
    else:
        f = _frame(long, period, before=4, after=4, rows=rows).pct_change(keep=4, diff=F.col("value"))
        f = _savgol_stage(f)
        f = f.roll(smooth_5=R.mean("value", 5))
        names = ("savgol", "smooth_5", "diff")
    variants = [F.struct(F.col("feature").alias("f"), F.col("value").alias("v"))] + [
        F.struct(F.concat("feature", F.lit(f"_{n}")).alias("f"), F.col(n).alias("v")) for n in names
    ]
    return f.own("symbol", "bar_ts", F.explode(F.array(*variants)).alias("x")).select(
        "symbol", "bar_ts", F.col("x.f").alias("feature"), N.sanitize(F.col("x.v")).alias("value")
    )


def normalise(long: DataFrame, period: float, p: float = 0.10, rows: int = BLOCK_ROWS) -> DataFrame:
    """Detrend, expanding z-score and winsorise over all cells, each step cleaned and written once."""
    keep = lambda df, c: df.select(*KEYS, "bar_ts", N.sanitize(c).alias("value"))
    flat = materialize(keep(col_detrend(long, period, rows), "detrended"), "detrended")
    scored = materialize(keep(zscore_expanding(flat, period, rows), "zscore"), "scored")
    return keep(winsorize_global(scored, p), "winsorized")


def col_detrend(long: DataFrame, period: float, rows: int = BLOCK_ROWS) -> DataFrame:
    """value minus its straight-line fit over the series, from block moments; what rounding leaves on the line is 0."""
    f = _frame(long, period, rows=rows)
    x, y = F.when(F.col("value").isNotNull(), F.col("_i").cast("double")), F.col("value")
    totals = {
        "_n": F.count(y), "_mx": F.avg(x), "_my": F.avg(y), "_vx": F.var_pop(x), "_cxy": F.covar_pop(x, y),
    }

    f = f.carry_with(totals, lambda part: lines(part, f.keys))
    f = f.add(_rise=F.col("_slope") * (F.col("_i") - F.col("_gx")))
    left = F.col("value") - (F.col("_gy") + F.col("_rise"))
    noise = F.abs(left) <= ROUNDING * F.greatest(F.abs("value"), F.abs("_gy") + F.abs("_rise"))
    return f.add(detrended=F.when(noise, 0.0).otherwise(left)).drop("_gx", "_gy", "_slope", "_rise").own()


def lines(part: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each series' straight line from its blocks' moments, beside every block."""
    every = Window.partitionBy(*keys)
    over = lambda c: F.sum(c).over(every)
    n = F.col("_n")
    part = part.select(
        "*",
        F.try_divide(over(n * F.col("_mx")), over(n)).alias("_gx"),
        F.try_divide(over(n * F.col("_my")), over(n)).alias("_gy"),
    )
    dx, dy = F.col("_mx") - F.col("_gx"), F.col("_my") - F.col("_gy")
    slope = F.try_divide(over(n * (F.col("_cxy") + dx * dy)), over(n * (F.col("_vx") + dx * dx)))
    return part.select(*keys, "_b", "_gx", "_gy", F.coalesce(slope, F.lit(0.0)).alias("_slope"))


def col_extrapolate(long: DataFrame, n: int = 10, ahead: int = 0) -> DataFrame:
    """Straight line through the last n values, one step on. `ahead` shifts the point further."""
    newest = Window.partitionBy(*KEYS).orderBy(F.col("bar_ts").desc())
    last = long.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= n)
    x = F.lit(float(n)) - F.col("_r")
    fit = last.groupBy(*KEYS).agg(
        F.regr_slope("value", x).alias("slope"), F.avg("value").alias("my"), F.avg(x).alias("mx")
    )
    point = F.lit(float(n + ahead)) - F.col("mx")
    return fit.select(*KEYS, (F.col("my") + F.coalesce("slope", F.lit(0.0)) * point).alias("next_value"))


def zscore_expanding(long: DataFrame, period: float, rows: int = BLOCK_ROWS) -> DataFrame:
    """Relative change of the log value's z-score against everything seen so far.

    One pass over the block summaries serves both the moments and the last known score, because the
    score of a block's last value follows from the moments up to that block.
    """
    f = _frame(long, period, rows=rows).add(_x=N.ln("value"))
    x = F.col("_x")
    totals = {
        "_n": F.count(x), "_m": F.avg(x), "_v": F.var_pop(x), "_end": F.max_by(x, F.when(x.isNotNull(), F.col("_i"))),
    }
    f = f.carry_with(totals, lambda part: earlier_moments(part, f))
    f = f.add(_n1=F.count(x).over(f.cum), _m1=F.avg(x).over(f.cum), _v1=F.var_pop(x).over(f.cum))
    zero = F.lit(0.0)
    n0, m0, s0, n1, m1, v1 = (F.coalesce(F.col(c), zero) for c in ("_n0", "_m0", "_s0", "_n1", "_m1", "_v1"))
    n = n0 + n1
    squares = s0 + n1 * v1 + F.coalesce(F.try_divide(n0 * n1, n), zero) * (m1 - m0) * (m1 - m0)
    f = f.add(_z=_score(x, n, F.try_divide(n0 * m0 + n1 * m1, n), squares))
    f = f.add(_p=F.coalesce(F.last("_z", ignorenulls=True).over(f.cum), "_z0"))
    f = f.add(zscore=N.div("_p", F.coalesce(F.lag("_p").over(f.w), "_z0")) - 1)
    return f.drop("_n0", "_m0", "_s0", "_z0", "_n1", "_m1", "_v1", "_x", "_z", "_p").own()


def _score(x: Column, n: Column, mean: Column, squares: Column) -> Column:
    return N.div(x - mean, F.when(n > 1, F.sqrt(F.try_divide(squares, n - 1))))


def earlier_moments(part: DataFrame, f: Frame) -> DataFrame:
    """Count, mean and squared deviations of all earlier blocks together, and the last score there."""
    by_block = Window.partitionBy(*f.keys).orderBy("_b")
    earlier = by_block.rowsBetween(Window.unboundedPreceding, -1)
    so_far = by_block.rowsBetween(Window.unboundedPreceding, 0)
    whole = by_block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Deviations are taken from the first block's mean, which keeps the sums of squares small.
    part = part.select("*", F.first("_m", ignorenulls=True).over(whole).alias("_base"))
    n, d = F.col("_n"), F.col("_m") - F.col("_base")

    def moments(w: WindowSpec) -> tuple[Column, Column, Column]:
        over = lambda c: F.sum(c).over(w)
        count, first = over(n).cast("double"), over(n * d)
        shift = F.try_divide(first, count)
        squares = F.greatest(over(n * (F.col("_v") + d * d)) - first * shift, F.lit(0.0))
        return count, F.col("_base") + shift, squares

    n0, m0, s0 = moments(earlier)
    part = part.select(
        "*", n0.alias("_n0"), m0.alias("_m0"), s0.alias("_s0"), _score(F.col("_end"), *moments(so_far)).alias("_z")
    )
    return part.select(
        *f.keys, "_b", "_n0", "_m0", "_s0", F.last("_z", ignorenulls=True).over(earlier).alias("_z0")
    )


def limit_ranks(counts: DataFrame, p: float) -> DataFrame:
    """Ranks of the lowest and highest value that stay when a share p is clamped at either end."""
    cut = F.floor(F.lit(float(p)) * F.col("n"))
    marks = F.array(
        F.struct(F.lit("low").alias("name"), (cut + 1).alias("rank")),
        F.struct(F.lit("high").alias("name"), (F.col("n") - cut).alias("rank")),
    )
    return counts.withColumn("_m", F.explode(marks)).select(
        *[c for c in counts.columns if c != "n"], F.col("_m.name").alias("name"), F.col("_m.rank").alias("rank")
    )


def _clamp(low: str, high: str) -> Column:
    return F.when(F.col("value").isNotNull(), F.least(F.greatest(F.col("value"), F.col(low)), F.col(high)))


def winsorize_global(long: DataFrame, p: float = 0.10) -> DataFrame:
    """Clamp the lowest and highest share p of all cells together (0.05 in the live form)."""
    keyed = long.withColumn("_g", F.lit(0))
    counts = keyed.groupBy("_g").agg(F.count("value").alias("n"))
    limits = order_statistics(keyed, ["_g"], "value", limit_ranks(counts, p), few=True)
    pair = limits.groupBy("_g").pivot("name", ["low", "high"]).agg(F.first("value"))
    return keyed.join(F.broadcast(pair), "_g").withColumn("winsorized", _clamp("low", "high")).drop("_g", "low", "high")


def winsorize_by_feature(long: DataFrame, period: float, p: float = 0.10, rows: int = BLOCK_ROWS) -> DataFrame:
    """The same per (symbol, feature); limits reach the cells block by block."""
    counts = long.groupBy(*KEYS).agg(F.count("value").alias("n"))
    limits = order_statistics(long, KEYS, "value", limit_ranks(counts, p))
    pair = limits.groupBy(*KEYS).pivot("name", ["low", "high"]).agg(F.first("value"))
    f = _frame(long, period, rows=rows)
    f = f.carry_with({"_t": F.count(F.lit(1))}, lambda part: part.drop("_t").join(pair, list(KEYS)))
    return f.add(winsorized=_clamp("low", "high")).drop("low", "high").own()


def minmax_norm(long: DataFrame, period: float, rows: int = BLOCK_ROWS) -> DataFrame:
    """Scale each series to -1..1."""
    f = _frame(long, period, rows=rows).carry(
        {"_lo": F.min("value"), "_hi": F.max("value")},
        {"_min": lambda _, every: F.min("_lo").over(every), "_max": lambda _, every: F.max("_hi").over(every)},
    )
    scaled = 2 * N.div(F.col("value") - F.col("_min"), F.col("_max") - F.col("_min")) - 1
    return f.add(norm=scaled).drop("_min", "_max").own()


def signal_zscore(long: DataFrame, period: float, rows: int = BLOCK_ROWS) -> DataFrame:
    """Whole-series z-score with the population deviation."""
    return zscore_series(_frame(long, period, rows=rows), zscore=F.col("value")).own()


def describe_features(long: DataFrame) -> DataFrame:
    """count, mean, std, min, quartiles (interpolated) and max per (symbol, feature)."""
    basic = long.groupBy(*KEYS).agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    marks = quantile_ranks(basic.select(*KEYS, "n"), KEYS, (0.25, 0.5, 0.75))
    sides = F.array(
        F.struct(F.lit("low").alias("side"), F.col("low").alias("rank"), (1 - F.col("weight")).alias("part")),
        F.struct(F.lit("high").alias("side"), F.col("high").alias("rank"), F.col("weight").alias("part")),
    )
    points = marks.select(*KEYS, "q", F.explode(sides).alias("s")).select(
        *KEYS,
        F.concat_ws("_", F.concat(F.lit("p"), (F.col("q") * 100).cast("int").cast("string")), "s.side").alias("name"),
        F.col("s.rank").alias("rank"),
        F.col("s.part").alias("part"),
    )
    values = order_statistics(long, KEYS, "value", points)
    weighted = points.join(values, [*KEYS, "name"]).groupBy(*KEYS).agg(
        *[
            F.sum(F.when(F.col("name").startswith(q), F.col("value") * F.col("part"))).alias(q)
            for q in ("p25", "p50", "p75")
        ]
    )
    return basic.join(weighted, list(KEYS), "left").withColumnRenamed("n", "count")
