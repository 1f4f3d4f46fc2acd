"""Bar features. Each operator takes gap-free bars and adds its columns.

The `add_*` functions work on a Frame, so a pipeline can stack them on one shuffle; the public
operator of the same name opens a frame with the rows it looks back on and closes it again.
Prices enter as logarithms; a price of zero has none and leaves a NULL.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import rolling as R
from barloom.functions.numeric import FILLER, div, ln, sqrt
from barloom.operators.frames import BLOCK_ROWS, Frame

TRADE_COST = 8 * math.log(100)  # scales volatility into the spread a trade has to beat


def windowed(before: int) -> Callable:
    """Turn a Frame stage that looks `before` rows back into a DataFrame operator."""

    def wrap(stage: Callable[..., Frame]) -> Callable[..., DataFrame]:
        @wraps(stage)
        def operator(df: DataFrame, period: float, rows: int = BLOCK_ROWS, **params) -> DataFrame:
            return stage(Frame.of(df, period, before=before, rows=rows), **params).own()

        operator.stage = stage
        operator.before = before
        return operator

    return wrap


def _scaled(f: Frame, out: str, x: str, n: int) -> Frame:
    """Rolling deviation times the root of the window."""
    f = f.roll(_sd=R.std(x, n))
    return f.add(**{out: F.col("_sd") * math.sqrt(n)}).drop("_sd")


def f_range_spread(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "spread3": F.col("open") - (F.col("low") + F.col("high")) / 2,
            "spread2": F.col("high") - F.col("low"),
        }
    )


def f_volume_plus1(df: DataFrame) -> DataFrame:
    return df.withColumn("volume_p1", F.col("volume") + 1)


@windowed(4)
def f_volatility5(f: Frame, price: str = "close") -> Frame:
    """price: close for the batch form, open for the live one."""
    return _scaled(f.logs(price), "Volatility", f"_ln_{price}", 5).drop(f"_ln_{price}")


@windowed(8)
def f_vol_of_vol5(f: Frame, price: str = "close") -> Frame:
    f = f_volatility5.stage(f, price).logs("Volatility")
    return _scaled(f, "Volatility2", "_ln_Volatility", 5).drop("_ln_Volatility")


@windowed(24)
def f_volatility25(f: Frame) -> Frame:
    return _scaled(f.logs("open"), "Volatility3", "_ln_open", 25).drop("_ln_open")


@windowed(48)
def f_vol_of_vol25(f: Frame) -> Frame:
    f = f_volatility25.stage(f).logs("Volatility3")
    return _scaled(f, "Volatility4", "_ln_Volatility3", 25).drop("_ln_Volatility3")


@windowed(24)
def f_volatility_mom(f: Frame) -> Frame:
    f = f_volatility25.stage(f_volatility5.stage(f))
    return f.pct_change(Volatility_mom=F.col("Volatility"), Volatility3_mom=F.col("Volatility3"))


@windowed(4)
def f_volatility_ratio(f: Frame) -> Frame:
    f = f_volatility5.stage(f).roll(_v5=R.mean("volume", 5))
    return f.add(
        Volatility_ratio=div("Volatility", "_v5"), Volatility_ratio_reversed=div("_v5", "Volatility")
    ).drop("_v5")


@windowed(4)
def f_tradeable_spread(f: Frame, base: str = "spread3", price: str = "close") -> Frame:
    """base: spread3 for the batch form, spread2 for the live one."""
    f = f_volatility5.stage(f, price)
    width = {"spread3": F.col("open") - (F.col("low") + F.col("high")) / 2, "spread2": F.col("high") - F.col("low")}
    return f.add(trade_able_spread=width[base] - sqrt(TRADE_COST * F.col("Volatility")))


@windowed(0)
def f_last_return(f: Frame, twice: bool = True, keep: int = 0) -> Frame:
    """Relative change of the log open; the batch form takes the log change of that once more."""
    f = f.pct_change(keep, last_return=ln("open"))
    if not twice:
        return f
    f = f.pct_change(keep, _again=ln("last_return"))
    return f.put(last_return=F.col("_again")).drop("_again")


@windowed(9)
def f_last_return_roll(f: Frame, twice: bool = True) -> Frame:
    f = f_last_return.stage(f, twice, keep=9)
    return roll_last_return(f)


def roll_last_return(f: Frame) -> Frame:
    x = "last_return"
    return f.roll(
        last_return_5mu=R.mean(x, 5),
        last_return_5_sum=R.total(x, 5),
        last_return_10mu=R.mean(x, 10),
        last_return_10_sum=R.total(x, 10),
    )


@windowed(14)
def f_std_normalized(f: Frame, price: str = "open", n: int = 15) -> Frame:
    x = f"_ln_{price}"
    f = f.logs(price).roll(_dev=R.std_pop(x, n), _mean=R.mean(x, n))
    return f.add(std_normalized=div("_dev", "_mean")).drop("_dev", "_mean", x)


@windowed(14)
def f_ma_ratio(f: Frame, price: str = "open", n: int = 15) -> Frame:
    x = f"_ln_{price}"
    f = f.logs(price).roll(_mean=R.mean(x, n))
    return f.add(ma_ratio=div(F.col(x) - F.col("_mean"), x)).drop("_mean", x)


@windowed(14)
def f_values_deviation(f: Frame, n: int = 15) -> Frame:
    p, v = "_ln_open", "_ln_volume"
    f = f.logs("open", "volume").roll(
        _mp=R.mean(p, n), _dp=R.std_pop(p, n), _mv=R.mean(v, n), _dv=R.std_pop(v, n)
    )
    return f.add(
        price_deviation=div(F.col(p) - F.col("_mp"), "_dp"), volume_deviation=div(F.col(v) - F.col("_mv"), "_dv")
    ).drop("_mp", "_dp", "_mv", "_dv", p, v)


def signed_volume(f: Frame, x: Column) -> Column:
    """Volume with the sign of the change of x; the first bar has none and counts as the filler."""
    return F.coalesce(F.signum(x - F.lag(x).over(f.w)) * F.col("volume"), F.lit(FILLER))


def series_moments(f: Frame, keep: int = 0, **columns: Column) -> Frame:
    """Count, mean and population variance of whole series, merged from block moments.

    Adds _count_<name>, _mean_<name>, _var_<name> and the value itself as _x_<name>.
    """
    f = f.add(**{f"_x_{n}": c for n, c in columns.items()})
    totals = {}
    for n in columns:
        totals |= {f"_n_{n}": F.count(f"_x_{n}"), f"_m_{n}": F.avg(f"_x_{n}"), f"_v_{n}": F.var_pop(f"_x_{n}")}

    def scan(part: DataFrame) -> DataFrame:
        every = Window.partitionBy(*f.keys)
        over = lambda c: F.sum(c).over(every)
        size = {n: F.col(f"_n_{n}") for n in columns}
        counts = [over(size[n]).alias(f"_count_{n}") for n in columns]
        means = [F.try_divide(over(size[n] * F.col(f"_m_{n}")), over(size[n])).alias(f"_mean_{n}") for n in columns]
        part = part.select("*", *counts, *means)
        gap = lambda n: F.col(f"_m_{n}") - F.col(f"_mean_{n}")
        inner = lambda n: over(size[n] * (F.col(f"_v_{n}") + gap(n) * gap(n)))
        variances = [F.try_divide(inner(n), F.col(f"_count_{n}")).alias(f"_var_{n}") for n in columns]
        kept = [f"_{k}_{n}" for n in columns for k in ("count", "mean")]
        return part.select(*f.keys, "_b", *kept, *variances)

    return f.carry_with(totals, scan, keep)


def zscore_series(f: Frame, keep: int = 0, **columns: Column) -> Frame:
    """(x - mean) / population deviation over the whole series."""
    f = series_moments(f, keep, **columns)
    scaled = lambda n: div(F.col(f"_x_{n}") - F.col(f"_mean_{n}"), F.sqrt(f"_var_{n}"))
    f = f.add(**{n: scaled(n) for n in columns})
    return f.drop(*[f"_{k}_{n}" for n in columns for k in ("x", "count", "mean", "var")])


@windowed(1)
def f_obv(f: Frame, price: str = "close") -> Frame:
    """OBV1 follows the open; OBV is the z-score of the same sum (over the open in the live form)."""
    f = f.running_sum(OBV1=signed_volume(f, F.col("open")), _obv=signed_volume(f, F.col(price)))
    return zscore_series(f, OBV=F.col("_obv")).drop("_obv")


@windowed(10)
def f_obv_smoothed(f: Frame) -> Frame:
    f = f.roll(_o10=R.mean("open", 10), _v10=R.mean("volume", 10))
    f = f.add(_ov=div("_o10", "_v10"))
    return f.running_sum(OBV2=signed_volume(f, F.col("_o10")), OBV3=signed_volume(f, F.col("_ov"))).drop(
        "_o10", "_v10", "_ov"
    )


@windowed(4)
def f_log_spread(f: Frame) -> Frame:
    f = f.logs("open", "low", "high")
    f = f.roll(_mo=R.mean("_ln_open", 5), _ml=R.mean("_ln_low", 5), _mh=R.mean("_ln_high", 5))
    return f.add(spread=F.abs(F.col("_mo") - (F.col("_ml") + F.col("_mh")) / 2)).drop(
        "_mo", "_ml", "_mh", "_ln_open", "_ln_low", "_ln_high"
    )


@windowed(8)
def f_variance(f: Frame) -> Frame:
    f = _scaled(f.logs("open"), "_sd5", "_ln_open", 5)
    return f.roll(variance=R.mean("_sd5", 5)).drop("_sd5", "_ln_open")


@windowed(8)
def f_var_bands(f: Frame) -> Frame:
    f = f_variance.stage(f) if "variance" not in f.df.columns else f
    f = f.logs("open").roll(_o5=R.mean("_ln_open", 5))
    return f.add(
        open_plus_var=F.col("_o5") + F.col("variance"), open_minus_var=F.col("_o5") - F.col("variance")
    ).drop("_o5", "_ln_open")


@windowed(9)
def f_var_band_diff(f: Frame) -> Frame:
    f = f_var_bands.stage(f).logs("open").roll(_o5=R.mean("_ln_open", 5))
    f = f.add(_band=F.lag("open_minus_var").over(f.w))
    f = f.pct_change(_change=F.col("_o5"))
    f = f.running_sum(open_var_diff=F.col("_change") - F.col("_band"))
    return f.drop("_o5", "_band", "_change", "_ln_open", "variance", "open_plus_var", "open_minus_var")


@windowed(4)
def f_mu(f: Frame) -> Frame:
    f = f.roll(_o5=R.mean("open", 5))
    f = f.pct_change(_change=ln("_o5"))
    return f.add(mu=F.abs(F.col("_change") / 2 * 10000)).drop("_o5", "_change")


@windowed(18)
def f_sigma(f: Frame) -> Frame:
    f = _scaled(f.logs("open"), "_sd15", "_ln_open", 15).roll(_m=R.mean("_sd15", 5))
    return f.add(sigma=F.col("_m") * 100).drop("_sd15", "_m", "_ln_open")


@windowed(18)
def f_market_impact(f: Frame, volume_offset: float = 0.0) -> Frame:
    """Needs `inventory`. volume_offset is 1 in the live form."""
    f = f_sigma.stage(f) if "sigma" not in f.df.columns else f
    f = f.roll(_v5=R.mean("volume", 5))
    impact = F.col("sigma") * sqrt(div(F.col("inventory"), F.col("_v5") + volume_offset))
    return f.add(market_impact=impact).drop("_v5")
