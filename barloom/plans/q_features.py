"""Bar features over hourly bars."""

from __future__ import annotations

from barloom.operators import bars as B
from barloom.operators import features as A
from barloom.operators.rsi import rsi
from barloom.plans import sqltext as S
from barloom.plans.catalog import HOUR, present, query
from barloom.session import materialize
from barloom.sources import fixtures


def hourly(spark, sf_dir):
    return B.bars(fixtures.trades(spark, sf_dir), HOUR)


def stored(spark, sf_dir):
    """Hourly bars written once, for operators that read their input twice."""
    return materialize(hourly(spark, sf_dir), "hourly")


# Features with a running state or a whole-series total.
CARRIED = {
    "f_volatility_mom", "f_last_return", "f_last_return_roll", "f_obv", "f_obv_smoothed", "f_var_band_diff", "f_mu",
}


def text(*steps: tuple[str, str], out: tuple[str, ...]) -> str:
    """Hourly bars, then the steps; each step is (name, columns added to the step before)."""
    chain, prior = S.bars(HOUR), "bars"
    for name, added in steps:
        chain.append((name, f"select *, {added} from {prior}"))
        prior = name
    return S.chain(*chain) + f"select {S.keyed(*out)} from {prior}"


def feature(name: str, out: tuple[str, ...], *steps: tuple[str, str]):
    """Register operator `name` over hourly bars with its SQL text."""
    run = getattr(A, name)

    @query(name, text(*steps, out=out))
    def _run(spark, sf_dir):
        b = stored(spark, sf_dir) if name in CARRIED else hourly(spark, sf_dir)
        done = run(b, HOUR) if hasattr(run, "stage") else run(b)
        return present(done, "symbol", "bar_ts", *out)


VOL5 = ("s1", f"{S.sd(S.ln('close'), 5)} * sqrt(5) as Volatility")
VOL25 = ("s2", f"{S.sd(S.ln('open'), 25)} * sqrt(25) as Volatility3")
VARIANCE = [("s1", f"{S.sd(S.ln('open'), 5)} * sqrt(5) as sd5"), ("s2", f"{S.ma('sd5', 5)} as variance")]
BANDS = [
    *VARIANCE,
    ("s3", f"{S.ma(S.ln('open'), 5)} as o5"),
    ("s4", "o5 + variance as open_plus_var, o5 - variance as open_minus_var"),
]
SIGMA = [("g1", f"{S.sd(S.ln('open'), 15)} * sqrt(15) as sd15"), ("g2", f"{S.ma('sd15', 5)} * 100 as sigma")]
MU = [
    ("m1", f"{S.ma('open', 5)} as mo5"),
    ("m2", f"last_value({S.ln('mo5')} ignore nulls) over {S.CUM} as mo5p"),
    ("m3", f"abs({S.pct('mo5p')} / 2 * 10000) as mu"),
]
RETURNS = [
    ("s1", f"last_value({S.ln('open')} ignore nulls) over {S.CUM} as lo"),
    ("s2", f"{S.pct('lo')} as r1"),
    ("s3", f"last_value({S.ln('r1')} ignore nulls) over {S.CUM} as lr"),
    ("s4", f"{S.pct('lr')} as last_return"),
]

feature("f_range_spread", ("spread3", "spread2"), ("s1", "open - (low + high) / 2 as spread3, high - low as spread2"))
feature("f_volatility5", ("Volatility",), VOL5)
feature("f_vol_of_vol5", ("Volatility2",), VOL5, ("s2", f"{S.sd(S.ln('Volatility'), 5)} * sqrt(5) as Volatility2"))
feature("f_volatility25", ("Volatility3",), VOL25)
feature("f_vol_of_vol25", ("Volatility4",), VOL25, ("s3", f"{S.sd(S.ln('Volatility3'), 25)} * sqrt(25) as Volatility4"))
feature(
    "f_volatility_mom",
    ("Volatility_mom", "Volatility3_mom"),
    VOL5,
    VOL25,
    ("s3", f"{S.pad('Volatility', 'p1')}, {S.pad('Volatility3', 'p3')}"),
    ("s4", f"{S.pct('p1')} as Volatility_mom, {S.pct('p3')} as Volatility3_mom"),
)
feature(
    "f_volatility_ratio",
    ("Volatility_ratio", "Volatility_ratio_reversed"),
    VOL5,
    ("s2", f"{S.ma('volume', 5)} as v5"),
    ("s3", f"{S.ratio('Volatility', 'v5')} as Volatility_ratio, {S.ratio('v5', 'Volatility')} as Volatility_ratio_reversed"),
)
feature(
    "f_tradeable_spread",
    ("trade_able_spread",),
    VOL5,
    ("s2", "open - (low + high) / 2 - sqrt(8 * ln(100) * Volatility) as trade_able_spread"),
)
feature("f_last_return", ("last_return",), *RETURNS)
feature(
    "f_last_return_roll",
    ("last_return_5mu", "last_return_5_sum", "last_return_10mu", "last_return_10_sum"),
    *RETURNS,
    (
        "s5",
        f"{S.ma('last_return', 5)} as last_return_5mu, {S.total('last_return', 5)} as last_return_5_sum, "
        f"{S.ma('last_return', 10)} as last_return_10mu, {S.total('last_return', 10)} as last_return_10_sum",
    ),
)
feature(
    "f_std_normalized",
    ("std_normalized",),
    ("s1", f"{S.ratio(S.sdp(S.ln('open'), 15), S.ma(S.ln('open'), 15))} as std_normalized"),
)
feature(
    "f_ma_ratio",
    ("ma_ratio",),
    ("s1", f"{S.ratio('(' + S.ln('open') + ' - ' + S.ma(S.ln('open'), 15) + ')', S.ln('open'))} as ma_ratio"),
)
feature(
    "f_values_deviation",
    ("price_deviation", "volume_deviation"),
    ("s1", f"{S.ln('open')} as p, {S.ln('volume')} as v"),
    (
        "s2",
        f"{S.ratio('(p - ' + S.ma('p', 15) + ')', S.sdp('p', 15))} as price_deviation, "
        f"{S.ratio('(v - ' + S.ma('v', 15) + ')', S.sdp('v', 15))} as volume_deviation",
    ),
)


def obv(x: str) -> str:
    return f"coalesce(sign({x} - lag({x}) over {S.SEQ}) * volume, 1e-7)"


feature(
    "f_obv",
    ("OBV1", "OBV"),
    ("s1", f"{obv('open')} as a, {obv('close')} as b"),
    ("s2", f"sum(a) over {S.CUM} as OBV1, sum(b) over {S.CUM} as b1"),
    ("s3", f"{S.ratio(f'(b1 - avg(b1) over {S.ALL})', f'stddev_pop(b1) over {S.ALL}')} as OBV"),
)
feature(
    "f_obv_smoothed",
    ("OBV2", "OBV3"),
    ("s1", f"{S.ma('open', 10)} as o10, {S.ma('volume', 10)} as v10"),
    ("s2", f"{S.ratio('o10', 'v10')} as ov"),
    ("s3", f"{obv('o10')} as a, {obv('ov')} as b"),
    ("s4", f"sum(a) over {S.CUM} as OBV2, sum(b) over {S.CUM} as OBV3"),
)
feature(
    "f_log_spread",
    ("spread",),
    ("s1", f"abs({S.ma(S.ln('open'), 5)} - ({S.ma(S.ln('low'), 5)} + {S.ma(S.ln('high'), 5)}) / 2) as spread"),
)
feature("f_variance", ("variance",), *VARIANCE)
feature("f_var_bands", ("open_plus_var", "open_minus_var"), *BANDS)
feature(
    "f_var_band_diff",
    ("open_var_diff",),
    *BANDS,
    ("s5", f"{S.pad('o5', 'o5p')}, lag(open_minus_var) over {S.SEQ} as band"),
    ("s6", f"{S.pct('o5p')} - band as d"),
    ("s7", f"case when d is not null then sum(d) over {S.CUM} end as open_var_diff"),
)
feature("f_mu", ("mu",), *MU)
feature("f_sigma", ("sigma",), *SIGMA)
feature("f_volume_plus1", ("volume_p1",), ("s1", "volume + 1 as volume_p1"))

EVENT_POSITIONS = (
    "event_positions",
    """select event_type as symbol, round(sum(case when user_id % 2 = 0 then value else -value end) / 100) as qty
       from events group by 1""",
)


@query(
    "f_market_impact",
    S.chain(
        *S.bars(HOUR),
        EVENT_POSITIONS,
        ("b1", "select b.*, coalesce(p.qty, 1.0) as inventory from bars b left join event_positions p using (symbol)"),
        ("b2", f"select *, {SIGMA[0][1]} from b1"),
        ("b3", f"select *, {SIGMA[1][1]}, {S.ma('volume', 5)} as v5 from b2"),
        ("b4", f"select *, sigma * {S.root(S.ratio('inventory', 'v5'))} as market_impact from b3"),
    )
    + f"select {S.keyed('market_impact')} from b4",
)
def f_market_impact(spark, sf_dir):
    from barloom.operators.quotes import inventory

    b = inventory(hourly(spark, sf_dir), fixtures.event_positions(spark, sf_dir))
    return present(A.f_market_impact(b, HOUR), "symbol", "bar_ts", "market_impact")


def rsi_sql(n: int, columns: tuple[str, ...], source: str, extra: tuple[tuple[str, str], ...] = ()) -> str:
    """The recurrence itself, one row at a time."""
    deltas = ", ".join(f"{c} - lag({c}) over {S.SEQ} as d_{c}" for c in columns)
    gains = ", ".join(f"greatest(d_{c}, 0) as u_{c}, greatest(-d_{c}, 0) as l_{c}" for c in columns)
    seeds = ", ".join(f"sum({k}_{c}) filter (where pos between 1 and {n}) / {n} as {k}_{c}" for c in columns for k in "ul")
    steps = ", ".join(f"(r.{k}_{c} * {n - 1} + x.{k}_{c}) / {n} as {k}_{c}" for c in columns for k in "ul")
    values = ", ".join(
        S.rounded(
            f"case when r.pos > {n} then case when r.l_{c} = 0 then 100.0 else 100 - 100 / (1 + r.u_{c} / r.l_{c}) end end",
            f"rsi_{c}",
        )
        for c in columns
    )
    return (
        "with recursive "
        + ",\n".join(f"{a} as ({b})" for a, b in [*S.bars(HOUR), *extra])
        + f""",
        x0 as (select *, row_number() over {S.SEQ} - 1 as pos, {deltas} from {source}),
        x as materialized (select symbol, bar_ts, pos, {gains} from x0),
        r as (
            select symbol, {n} as pos, {seeds} from x group by symbol
            union all
            select r.symbol, r.pos + 1 as pos, {steps} from r join x on x.symbol = r.symbol and x.pos = r.pos + 1
        )
        select x.symbol, x.bar_ts, {values} from x left join r on x.symbol = r.symbol and x.pos = r.pos"""
    )


RSI_VWAP = (
    (
        "v",
        f"select *, coalesce(sum(volume * open) over {S.CUM} / nullif(sum(volume) over {S.CUM}, 0), 1e-7) as D_vwap from bars",
    ),
)


@query("f_rsi", rsi_sql(5, ("open", "close", "volume", "D_vwap"), "v", RSI_VWAP))
def f_rsi(spark, sf_dir):
    from barloom.functions.numeric import sanitize

    b = B.vwap_bar_open(stored(spark, sf_dir), HOUR, name="D_vwap")
    b = materialize(b.withColumn("D_vwap", sanitize("D_vwap")), "vwap")
    columns = ["open", "close", "volume", "D_vwap"]
    return present(rsi(b, HOUR, columns, n=5), "symbol", "bar_ts", *[f"rsi_{c}" for c in columns])


RSI14 = ("open", "high", "low", "close", "volume")


@query("f_rsi_14", rsi_sql(14, RSI14, "bars"))
def f_rsi_14(spark, sf_dir):
    return present(rsi(stored(spark, sf_dir), HOUR, RSI14, n=14), "symbol", "bar_ts", *[f"rsi_{c}" for c in RSI14])
