"""The batch job's tables: bars to base columns, cells, normalised cells, predictions of the models, and orders."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions import rolling as R
from barloom.functions.numeric import div, finite, ln, sanitize, sqrt
from barloom.operators import cellblocks as C
from barloom.operators import decisions as D
from barloom.operators import features as A
from barloom.operators import quotes as Q
from barloom.operators import symbol_models as M
from barloom.operators.frames import Frame
from barloom.operators.rsi import rsi_stage
from barloom.session import materialize

ROWS = 2048  # block length that also suits the 5-bar RSI
BEFORE = 64  # longest look-back of the rolling stages is 48, plus the rows later stages keep
KEEP = 9

RSI_COLUMNS = ("open", "close", "volume", "D_vwap")

# Names of the base columns, in the order of the batch form.
BASE = [
    "open",
    "high",
    "low",
    "close",
    "volume",
    "vwap",
    "D_vwap",
    "inventory",
    "gamma",
    "k",
    "bid_alpha",
    "ask_alpha",
    "spread3",
    "spread2",
    "Volatility",
    "Volatility_mom",
    "Volatility2",
    "Volatility3",
    "Volatility3_mom",
    "Volatility4",
    "Volatility_ratio",
    "Volatility_ratio_reversed",
    "trade_able_spread",
    "last_return",
    "last_return_5mu",
    "last_return_5_sum",
    "last_return_10mu",
    "last_return_10_sum",
    "std_normalized",
    "ma_ratio",
    "OBV",
    "OBV1",
    "rsi_open",
    "rsi_close",
    "rsi_volume",
    "rsi_D_vwap",
    "spread",
    "variance",
    "open_plus_var",
    "open_minus_var",
    "open_var_diff",
    "mu",
    "sigma",
    "volume_p1",
    "market_impact",
    "bid_spread_aysm",
    "ask_spread_aysm",
    "bid_spread_aysm2",
    "ask_spread_aysm2",
    "inventory_risk_roc",
    "inventory_risk_roc_norm",
    "inventory_derivative",
    "sigma_derivative",
    "k_derivative",
    "a_derivative",
    "indefinite_integral",
    "indefinite_integral2",
]


def base_features(bars: DataFrame, period: float, rows: int = ROWS) -> DataFrame:
    """All base columns of gap-free bars that already have `inventory` and `gamma`.

    Three written stages: what looks back a fixed number of rows plus the first running state, what
    needs that state, and the RSI. Each stage is one shuffle by (symbol, block).
    """
    f = Frame.of(A.f_volume_plus1(A.f_range_spread(bars)), period, before=BEFORE, rows=rows)
    lo, r5, r15, r25 = "_ln_open", math.sqrt(5), math.sqrt(15), math.sqrt(25)
    f = f.logs("open", "close", "low", "high").roll(
        _c5=R.std("_ln_close", 5), _o5sd=R.std(lo, 5), _o15sd=R.std(lo, 15), _o25sd=R.std(lo, 25),
        _lo5=R.mean(lo, 5), _lo15=R.mean(lo, 15), _dev15=R.std_pop(lo, 15),
        _ll5=R.mean("_ln_low", 5), _lh5=R.mean("_ln_high", 5), _o5=R.mean("open", 5),
        _v5=R.mean("volume", 5), _v25=R.mean("volume", 25),
    )
    f = f.add(
        Volatility=F.col("_c5") * r5, Volatility3=F.col("_o25sd") * r25,
        _sd5=F.col("_o5sd") * r5, _sd15=F.col("_o15sd") * r15,
        std_normalized=div("_dev15", "_lo15"), ma_ratio=div(F.col(lo) - F.col("_lo15"), lo),
        spread=F.abs(F.col("_lo5") - (F.col("_ll5") + F.col("_lh5")) / 2),
    ).drop("_c5", "_o5sd", "_o15sd", "_o25sd", "_dev15", "_lo15", "_ll5", "_lh5", "_ln_close", "_ln_low", "_ln_high")
    f = f.logs("Volatility", "Volatility3").roll(
        _vv5=R.std("_ln_Volatility", 5), _vv25=R.std("_ln_Volatility3", 25),
        variance=R.mean("_sd5", 5), _s5=R.mean("_sd15", 5),
    )
    k = ln(div(F.col("_v5"), ln("_v25")))
    f = f.add(
        Volatility2=F.col("_vv5") * r5, Volatility4=F.col("_vv25") * r25, sigma=F.col("_s5") * 100,
        k=sanitize(k), _alpha=finite(div("_v5", "_v25") / F.exp(k)),
        open_plus_var=F.col("_lo5") + F.col("variance"), open_minus_var=F.col("_lo5") - F.col("variance"),
        Volatility_ratio=div("Volatility", "_v5"), Volatility_ratio_reversed=div("_v5", "Volatility"),
        trade_able_spread=F.col("spread3") - F.sqrt(A.TRADE_COST * F.col("Volatility")),
    )
    f = f.add(
        market_impact=F.col("sigma") * sqrt(div(F.col("inventory"), "_v5")),
        bid_alpha=sanitize("_alpha"), ask_alpha=sanitize("_alpha"),
        _band=F.lag("open_minus_var").over(f.w),
        _step_open=A.signed_volume(f, F.col("open")), _step_close=A.signed_volume(f, F.col("close")),
    ).drop("_vv5", "_vv25", "_s5", "_sd5", "_sd15", "_v5", "_v25", "_alpha", "_ln_Volatility", "_ln_Volatility3")
    v = F.col("volume")
    f = f.store("base-1").running(
        keep=KEEP,
        sums={
            "OBV1": F.col("_step_open"), "_obv": F.col("_step_close"), "_vol": v,
            "_hl": v * (F.col("high") + F.col("low")) / 2, "_op": v * F.col("open"),
        },
        changes={
            "Volatility_mom": F.col("Volatility"), "Volatility3_mom": F.col("Volatility3"),
            "_r1": F.col("_ln_open"), "_do5": F.col("_lo5"), "_dmu": ln("_o5"),
        },
    )
    f = f.add(
        vwap=div("_hl", "_vol"), D_vwap=sanitize(div("_op", "_vol")), mu=F.abs(F.col("_dmu") / 2 * 10000),
        _var_step=F.col("_do5") - F.col("_band"),
    ).drop("_ln_open", "_lo5", "_o5", "_band", "_step_open", "_step_close", "_vol", "_hl", "_op", "_do5", "_dmu")

    f = f.store("base-2").running(
        keep=KEEP, sums={"open_var_diff": F.col("_var_step")}, changes={"last_return": ln("_r1")}
    )
    f = A.roll_last_return(f.drop("_var_step", "_r1"))
    f = A.zscore_series(f, keep=KEEP, OBV=F.col("_obv")).drop("_obv")
    out = rsi_stage(f.store("base-3"), RSI_COLUMNS, n=5).own()

    out = Q.spread_drift(Q.spread_sym(out))
    raw = [c for c in out.columns if c not in ("symbol", "bar_ts")]
    out = materialize(out.withColumns({c: sanitize(c) for c in raw}), "base-4")
    for derive in (Q.d_gamma, Q.d_inventory, Q.d_sigma, Q.d_k, Q.d_a, Q.integrals):
        out = derive(out)
    out = Q.norm_series(out, period, "inventory_risk_roc", "inventory_risk_roc_norm", rows)
    return out.select("symbol", "bar_ts", *[sanitize(c).alias(c) for c in BASE])


def columns(base: Sequence[str] = BASE) -> list[str]:
    """Names of all cells of the batch form, in the order of the base columns."""
    ratios = [f"{c}{by}" for c in base for by in ("", "_div_volume", "_div_variance")]
    return [f"{c}{v}" for c in ratios for v in ("", "_savgol", "_smooth_5", "_diff")]


def expanded(base: DataFrame, period: float, columns: Sequence[str] | None = None) -> DataFrame:
    """Base columns to all cells: ratios to volume and variance, then smoothing and changes."""
    return C.to_long(C.expand(base, period, columns or BASE), period)


def cell_blocks(base: DataFrame, period: float, columns: Sequence[str] | None = None, p: float = 0.10) -> DataFrame:
    """Normalised cells, the model's input, in blocks (see cellblocks.py)."""
    return C.normalise(C.expand(base, period, columns or BASE), p)


def cells(base: DataFrame, period: float, columns: Sequence[str] | None = None, p: float = 0.10) -> DataFrame:
    """Normalised cells in long form."""
    return C.to_long(cell_blocks(base, period, columns, p), period)


def predictions(cells: DataFrame, bars: DataFrame, period: float, trees: int = 100, patience: int = 15, last: int = 2) -> DataFrame:
    """Models of every symbol and side on the normalised cells, and what they say of the last bars."""
    data = M.inputs(cells, bars, period, columns())
    return M.predict(M.newest(cells, bars, last, period), M.tree_rows(data, M.train(data, trees, patience)))


def orders(predicted: DataFrame, desk: DataFrame) -> DataFrame:
    """Bracket orders of the newest predictions; `desk` has res, best_bid, best_ask and risk per symbol."""
    return D.bracket(D.entries(M.orders_input(predicted, desk)))
