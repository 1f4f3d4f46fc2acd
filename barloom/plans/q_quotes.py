"""Order book, quote model, calibration and scenarios."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from barloom.operators import bars as B
from barloom.operators import book as K
from barloom.operators import quotes as Q
from barloom.operators import scenarios as C
from barloom.operators.features import f_variance
from barloom.plans import sqltext as S
from barloom.plans.catalog import DAY, HOUR, present, query
from barloom.plans.q_features import EVENT_POSITIONS, SIGMA, VARIANCE, hourly, stored
from barloom.session import materialize
from barloom.sources import fixtures
from barloom.sources.book import flatten_book

# ---- order book ---------------------------------------------------------------------------

BOOK = (
    "book_levels",
    """select symbol, side, price, quantity, row_number() over (partition by symbol, side
           order by case when side = 'ask' then price else -price end, quantity, id1, id2, id3) - 1 as level
       from (select 'S' || l_suppkey as symbol, case when l_linestatus = 'O' then 'ask' else 'bid' end as side,
                    l_extendedprice / l_quantity as price, l_quantity as quantity,
                    l_orderkey as id1, l_linenumber as id2, l_partkey as id3 from lineitem)""",
)
DEPTH = ("depth", "select * from book_levels where level < 10")
TOP = (
    "top",
    """select symbol, max(price) filter (where side = 'ask' and level = 0) as best_ask,
              max(price) filter (where side = 'bid' and level = 0) as best_bid from depth group by 1""",
)
MID = ("mid", "select *, (best_ask + best_bid) / 2 as midpoint from top")
WEIGHTED = (
    "weighted",
    """select symbol, any_value(midpoint) as midpoint,
              sum(quantity / nullif(abs(price - midpoint), 0)) filter (where side = 'ask') * count(*) filter (where side = 'ask') as ask_depth,
              sum(quantity / nullif(abs(price - midpoint), 0)) filter (where side = 'bid') * count(*) filter (where side = 'bid') as bid_depth
       from depth join mid using (symbol) group by 1""",
)
TILT = ("tilted", "select *, (ask_depth - bid_depth) / nullif((ask_depth + bid_depth) / 2, 0) as tilt from weighted")
ALPHA = (
    "alphas",
    """select *, abs(tilt) as alpha, case when tilt <= 0 then 0.002 else tilt end as ask_alpha,
              case when -tilt <= 0 then 0.002 else -tilt end as bid_alpha from tilted""",
)
BOOK_STEPS = (BOOK, DEPTH, TOP, MID, WEIGHTED, TILT, ALPHA)


def depth(spark, sf_dir):
    return K.book_depth(fixtures.book_quotes(spark, sf_dir), 10, fixtures.BOOK_ORDER)


@query("src_book", S.chain(BOOK) + f"select symbol, side, level, {S.cols('price', 'quantity')} from book_levels")
def src_book(spark, sf_dir):
    return present(flatten_book(fixtures.book_messages(spark, sf_dir)))


@query("book_top", S.chain(*BOOK_STEPS) + f"select symbol, {S.cols('best_ask', 'best_bid', 'midpoint')} from mid")
def book_top(spark, sf_dir):
    return present(K.book_top(depth(spark, sf_dir)))


@query("book_depth10", S.chain(*BOOK_STEPS) + f"select symbol, side, level, {S.cols('price', 'quantity')} from depth")
def book_depth10(spark, sf_dir):
    return present(depth(spark, sf_dir).withColumn("level", F.col("level").cast("long")))


@query("book_weighted_depth", S.chain(*BOOK_STEPS) + f"select symbol, {S.cols('midpoint', 'ask_depth', 'bid_depth')} from weighted")
def book_weighted_depth(spark, sf_dir):
    return present(K.weighted_depth(depth(spark, sf_dir)))


@query("book_alpha", S.chain(*BOOK_STEPS) + f"select symbol, {S.cols('alpha', 'ask_alpha', 'bid_alpha')} from alphas")
def book_alpha(spark, sf_dir):
    return present(K.book_alpha(K.weighted_depth(depth(spark, sf_dir))), "symbol", "alpha", "ask_alpha", "bid_alpha")


SYMBOLS = (
    "wanted",
    "select 'S' || s_suppkey as symbol from supplier union all select 'N' || n_nationkey from nation",
)
DEFAULTS = {"ask_alpha": 0.5, "bid_alpha": 0.5, "ask_depth": 10000.0, "bid_depth": 10000.0, "midpoint": 999.0}


@query(
    "book_defaults",
    S.chain(*BOOK_STEPS, SYMBOLS)
    + "select symbol, "
    + ", ".join(S.rounded(f"case when alpha is null then {v} else {c} end", c) for c, v in DEFAULTS.items())
    + " from wanted left join alphas using (symbol)",
)
def book_defaults(spark, sf_dir):
    alphas = K.book_alpha(K.weighted_depth(depth(spark, sf_dir)))
    return present(K.book_defaults(fixtures.symbol_list(spark, sf_dir), alphas))


# ---- positions and risk -------------------------------------------------------------------

POSITIONS = [
    S.TRADES_DAILY,
    (
        "held",
        """select 'S' || l_suppkey as symbol,
                  coalesce(sum(case l_returnflag when 'A' then l_quantity when 'R' then -l_quantity end), 0.0) as qty,
                  sum(l_extendedprice) / sum(l_quantity) as avg_entry_price from lineitem group by 1""",
    ),
    (
        "last_two",
        """select symbol, max(case when r = 1 then price end) as current_price, max(case when r = 2 then price end) as prior_price
           from (select symbol, price, row_number() over (partition by symbol order by ts desc, seq desc) as r from trades_daily)
           where r <= 2 group by 1""",
    ),
    (
        "positions",
        """select symbol, qty, case when qty < 0 then 'SHORT' else 'LONG' end as side, avg_entry_price, current_price, prior_price,
                  (current_price - avg_entry_price) * qty as unrealized_pl,
                  (current_price - prior_price) * qty as unrealized_intraday_pl, qty as qty_available
           from held join last_two using (symbol)""",
    ),
]

DAILY_VARIANCE = [
    *S.bars(DAY, S.TRADES_DAILY)[1:],
    ("v1", f"select *, {VARIANCE[0][1]} from bars"),
    ("v2", f"select *, {VARIANCE[1][1]} from v1"),
    ("lastv", "select symbol, arg_max(coalesce(variance, 1e-7), bar_ts) as variance from v2 group by 1"),
]


@query(
    "q_gamma",
    S.chain(
        *POSITIONS,
        *DAILY_VARIANCE,
        SYMBOLS,
        ("rules", "select 'S' || s_suppkey as symbol from supplier where s_nationkey < 5"),
        (
            "g",
            """select w.symbol, case when k.qty is null then 0.01 * (1 - coalesce(v.variance, 0.3))
                      when r.symbol is not null then 0.01 * abs(trunc(k.qty)) else abs(trunc(k.qty)) / 1000 end as gamma
               from wanted w left join positions k using (symbol) left join rules r using (symbol) left join lastv v using (symbol)""",
        ),
    )
    + f"select symbol, {S.cols('gamma')} from g",
)
def q_gamma(spark, sf_dir):
    daily = B.newest_bars(fixtures.trades_daily(spark, sf_dir), DAY, 9)  # what the last variance looks back on
    last = C.last_bars(f_variance(daily, DAY), 1).select(
        "symbol", F.coalesce("variance", F.lit(1e-7)).alias("current_variance")
    )
    held = fixtures.held(spark, sf_dir)
    symbols = fixtures.symbol_list(spark, sf_dir).join(last, "symbol", "left")
    variance = F.coalesce("current_variance", F.lit(0.3))
    return present(Q.gamma(symbols, held, fixtures.symbol_rules(spark, sf_dir), variance), "symbol", "gamma")


@query(
    "q_inventory",
    S.chain(*POSITIONS, SYMBOLS)
    + f"select symbol, {S.rounded('coalesce(trunc(qty), 1.0)', 'inventory')} from wanted left join positions using (symbol)",
)
def q_inventory(spark, sf_dir):
    return present(Q.inventory(fixtures.symbol_list(spark, sf_dir), fixtures.held(spark, sf_dir)))


# ---- quote model over hourly bars -----------------------------------------------------------

INPUTS = [
    *S.bars(HOUR),
    EVENT_POSITIONS,
    (
        "b1",
        """select b.*, coalesce(trunc(p.qty), 1.0) as inventory,
                  case when p.qty is null then 0.01 * (1 - 0.3) else abs(trunc(p.qty)) / 1000 end as gamma
           from bars b left join event_positions p using (symbol)""",
    ),
    ("b2", f"select *, {SIGMA[0][1]}, {VARIANCE[0][1]}, {S.ma('volume', 5)} as v5, {S.ma('volume', 25)} as v25, {S.ma('open', 5)} as mo5 from b1"),
    (
        "b3",
        f"""select *, {SIGMA[1][1]}, {VARIANCE[1][1]}, v5 / nullif(v25, 0) as share,
               {S.ln('(v5 / nullif(' + S.ln('v25') + ', 0))')} as k0,
               last_value({S.ln('mo5')} ignore nulls) over {S.CUM} as mo5p from b2""",
    ),
    (
        "b4",
        f"""select *, share / exp(k0) as al, abs({S.pct('mo5p')} / 2 * 10000) as mu,
               sigma * {S.root(S.ratio('inventory', 'v5'))} as market_impact from b3""",
    ),
    ("b5", "select *, coalesce(k0, 1e-7) as k, coalesce(al, 1e-7) as bid_alpha, coalesce(al, 1e-7) as ask_alpha from b4"),
]


def inputs(spark, sf_dir):
    b = Q.inventory(hourly(spark, sf_dir), fixtures.event_positions(spark, sf_dir))
    b = Q.gamma(b, fixtures.event_positions(spark, sf_dir))
    return Q.quote_inputs(materialize(b, "quote-bars"), HOUR)


@query("q_k", S.chain(*INPUTS) + f"select symbol, bar_ts, {S.rounded('k0', 'k')} from b4")
def q_k(spark, sf_dir):
    return present(Q.arrival(hourly(spark, sf_dir), HOUR), "symbol", "bar_ts", "k")


@query("q_alpha", S.chain(*INPUTS) + f"select symbol, bar_ts, {S.rounded('al', 'bid_alpha')}, {S.rounded('al', 'ask_alpha')} from b4")
def q_alpha(spark, sf_dir):
    return present(Q.arrival(hourly(spark, sf_dir), HOUR), "symbol", "bar_ts", "bid_alpha", "ask_alpha")


def fin(x: str) -> str:
    return f"(case when isfinite({x}) then {x} end)"


GROW = fin("(case when 1 + g / nullif(k, 0) > 0 then exp((1 + k / nullif(g, 0)) * ln(1 + g / nullif(k, 0))) end)")
ENTRY = "(case when 1 + g / nullif(k, 0) > 0 then ln(1 + g / nullif(k, 0)) end)"


def named(source: str, gamma: str = "gamma") -> tuple[str, str]:
    return (
        "n1",
        f"select *, sigma as s, {gamma} as g, inventory as q, mu as m, bid_alpha as a from {source}",
    )


TERMS = ("n2", f"select *, {GROW} as e, {ENTRY} as l from n1")
WIDTH = lambda num, a: S.root(fin(f"({num} / nullif(2 * k * {a}, 0) * e)"))


def spreads(name: str, bid: str, ask: str, out: tuple[str, str]):
    return S.chain(*INPUTS, named("b5"), TERMS, ("r", f"select *, {fin(bid)} as {out[0]}, {fin(ask)} as {out[1]} from n2")) + (
        f"select {S.keyed(*out)} from r"
    )


@query(
    "q_spread_sym",
    spreads(
        "q_spread_sym",
        f"(l / nullif(g, 0) + (2 * q + 1) / 2 * {WIDTH('s * s * g', 'bid_alpha')})",
        f"(l / nullif(g, 0) - (2 * q - 1) / 2 * {WIDTH('s * s * g', 'ask_alpha')})",
        ("bid_spread_aysm", "ask_spread_aysm"),
    ),
)
def q_spread_sym(spark, sf_dir):
    return present(Q.spread_sym(inputs(spark, sf_dir)), "symbol", "bar_ts", "bid_spread_aysm", "ask_spread_aysm")


DRIFT_BID = f"(l / nullif(g, 0) + (-m / nullif(g * s * s, 0) + (2 * q + 1) / 2) * {WIDTH('s * s * k', 'bid_alpha')})"
DRIFT_ASK = f"(l / nullif(g, 0) + (m / nullif(g * s * s, 0) - (2 * q - 1) / 2) * {WIDTH('s * s * k', 'ask_alpha')})"


@query(
    "q_spread_drift",
    spreads("q_spread_drift", f"({DRIFT_BID} / 1000)", f"({DRIFT_ASK} / 1000)", ("bid_spread_aysm2", "ask_spread_aysm2")),
)
def q_spread_drift(spark, sf_dir):
    return present(Q.spread_drift(inputs(spark, sf_dir)), "symbol", "bar_ts", "bid_spread_aysm2", "ask_spread_aysm2")


GROW3 = fin("(case when 1 + g * k > 0 then exp((1 + k * g) * ln(1 + g * k)) end)")
WIDTH3 = lambda a: f"{fin('exp(k / 4 * market_impact)')} * {S.root(fin(f'(s * 2 * g / nullif(2 * k * {a}, 0) * {GROW3})'))}"


@query(
    "q_spread_impact",
    spreads(
        "q_spread_impact",
        f"(l / nullif(g, 0) + market_impact / 2 + (2 * q + 1) / 2 * {WIDTH3('bid_alpha')})",
        f"(l / nullif(g, 0) + market_impact / 2 - (2 * q - 1) / 2 * {WIDTH3('ask_alpha')})",
        ("bid_spread_aysm3", "ask_spread_aysm3"),
    ),
)
def q_spread_impact(spark, sf_dir):
    return present(Q.spread_impact(inputs(spark, sf_dir)), "symbol", "bar_ts", "bid_spread_aysm3", "ask_spread_aysm3")


STATS = ("mean", "std", "min", "p25", "p50", "p75", "max")


def stats_sql(value: str, by: str, source: str) -> str:
    return f"""select {by}, count({value}) as "count", avg({value}) as mean, stddev_samp({value}) as std, min({value}) as min,
        quantile_cont({value}, 0.25) as p25, quantile_cont({value}, 0.5) as p50, quantile_cont({value}, 0.75) as p75,
        max({value}) as max from {source} group by {by}"""


@query(
    "q_gamma_sweep",
    S.chain(
        *INPUTS,
        ("lastb", "select *, row_number() over (partition by symbol order by bar_ts desc) as r from b5"),
        ("swept", "select * exclude (gamma), j * 0.001 as gamma from lastb, range(1, 1001) t(j) where r = 1"),
        named("swept"),
        TERMS,
        ("u", f"select symbol, 'bid' as side, {fin(DRIFT_BID)} as spread from n2 union all select symbol, 'ask', {fin(DRIFT_ASK)} from n2"),
        ("st", stats_sql("spread", "symbol, side", "u")),
    )
    + f'select symbol, side, "count", {S.cols(*STATS)} from st',
)
def q_gamma_sweep(spark, sf_dir):
    return present(Q.gamma_sweep(inputs(spark, sf_dir)))


SENSITIVITY = [
    *INPUTS,
    (
        "c5",
        """select * replace (coalesce(sigma, 1e-7) as sigma, coalesce(mu, 1e-7) as mu, coalesce(variance, 1e-7) as variance) from b5""",
    ),
    named("c5"),
    TERMS,
    (
        "n3",
        f"""select *, {S.root(fin('(e * s * s / nullif(a, 0))'))} as rr,
               0.5 * (1 - 2 * q) + m / nullif(g * s * s, 0) as qq, 1 + g / nullif(k, 0) as bb from n2""",
    ),
]


def sensitivity(spark, sf_dir):
    return Q.fill_inputs(inputs(spark, sf_dir))


def derived(expr: dict[str, str]) -> str:
    cols = ", ".join(f"{fin('(' + e + ')')} as {n}" for n, e in expr.items())
    return S.chain(*SENSITIVITY, ("r", f"select *, {cols} from n3")) + f"select {S.keyed(*expr)} from r"


D_GAMMA = """s * s * e * ((k / nullif(g, 0) + 1) / nullif(k * bb, 0) - k * l / nullif(g * g, 0)) * qq / nullif(2 * sqrt(2) * a * rr, 0)
    - m * rr / nullif(sqrt(2) * g * g * s * s, 0) - l / nullif(g * g, 0) + 1 / nullif(g * k * bb, 0)"""


@query(
    "q_d_gamma",
    S.chain(
        *SENSITIVITY,
        ("r1", f"select *, {fin('(' + D_GAMMA + ')')} as inventory_risk_roc from n3"),
        (
            "r",
            f"""select *, 2 * (inventory_risk_roc - min(inventory_risk_roc) over {S.ALL})
               / nullif(max(inventory_risk_roc) over {S.ALL} - min(inventory_risk_roc) over {S.ALL}, 0) - 1 as inventory_risk_roc_norm from r1""",
        ),
    )
    + f"select {S.keyed('inventory_risk_roc', 'inventory_risk_roc_norm')} from r",
)
def q_d_gamma(spark, sf_dir):
    d = materialize(Q.d_gamma(sensitivity(spark, sf_dir)).select("symbol", "bar_ts", "inventory_risk_roc"), "roc")
    return present(Q.norm_series(d, HOUR, "inventory_risk_roc", "inventory_risk_roc_norm"))


@query("q_d_inventory", derived({"inventory_derivative": "-rr / sqrt(2)"}))
def q_d_inventory(spark, sf_dir):
    return present(Q.d_inventory(sensitivity(spark, sf_dir)), "symbol", "bar_ts", "inventory_derivative")


@query(
    "q_d_sigma",
    derived({"sigma_derivative": "e * qq * s / nullif(sqrt(2) * a * rr, 0) - sqrt(2) * m * rr / nullif(g * s * s * s, 0)"}),
)
def q_d_sigma(spark, sf_dir):
    return present(Q.d_sigma(sensitivity(spark, sf_dir)), "symbol", "bar_ts", "sigma_derivative")


@query(
    "q_d_k",
    derived(
        {
            "k_derivative": """-1.0 / nullif(bb * k * k, 0) + e * qq * s * s
                * (-g * (1 + k / nullif(g, 0)) / nullif(bb * k * k, 0) + l / nullif(g, 0)) / nullif(2 * sqrt(2) * a * rr, 0)"""
        }
    ),
)
def q_d_k(spark, sf_dir):
    return present(Q.d_k(sensitivity(spark, sf_dir)), "symbol", "bar_ts", "k_derivative")


@query("q_d_a", derived({"a_derivative": "-e * qq * s * s / nullif(2 * sqrt(2) * a * a * rr, 0)"}))
def q_d_a(spark, sf_dir):
    return present(Q.d_a(sensitivity(spark, sf_dir)), "symbol", "bar_ts", "a_derivative")


BODY = f"(g * (1 - 2 * q) * s * s + 4 * m * {S.ln('s')})"


@query(
    "q_integrals",
    derived(
        {
            "indefinite_integral": f"-rr * {BODY} / nullif(8 * sqrt(2) * a * g * s, 0)",
            "indefinite_integral2": f"(8 * s * s * l + sqrt(2) * rr * {BODY}) / nullif(8 * g * s, 0)",
        }
    ),
)
def q_integrals(spark, sf_dir):
    return present(
        Q.integrals(sensitivity(spark, sf_dir)), "symbol", "bar_ts", "indefinite_integral", "indefinite_integral2"
    )


AS_OF = "2024-01-30 15:07:20"
LEFT = f"round_even(epoch(date_trunc('day', timestamp '{AS_OF}') + interval '22 hours' - timestamp '{AS_OF}') / 60.0, 0)"
LAST = ("lastb", "select *, row_number() over (partition by symbol order by bar_ts desc) as rn from c5")
PRICE = f"close - inventory * gamma * (variance * 1000) * (1 - {LEFT} / 420) / 40"


@query(
    "q_reservation",
    S.chain(*SENSITIVITY, LAST, ("r", f"select *, {PRICE} as res from lastb where rn = 1")) + f"select {S.keyed('res')} from r",
)
def q_reservation(spark, sf_dir):
    return present(Q.reservation(sensitivity(spark, sf_dir), AS_OF), "symbol", "bar_ts", "res")


@query(
    "q_reservation_sweep",
    S.chain(
        *SENSITIVITY,
        LAST,
        ("swept", "select * exclude (gamma), j * 0.0001 as gamma from lastb, range(1, 1001) t(j) where rn = 1"),
        ("u", f"select symbol, {PRICE} as res from swept"),
        ("st", stats_sql("res", "symbol", "u")),
    )
    + f'select symbol, "count", {S.cols(*STATS)} from st',
)
def q_reservation_sweep(spark, sf_dir):
    return present(Q.reservation_sweep(sensitivity(spark, sf_dir), AS_OF))


# ---- calibration ------------------------------------------------------------------------

FILLS = (
    "fills",
    """select 'S' || l_suppkey as symbol, l_linenumber / 100.0 as "offset", o_orderdate as placed_ts,
              case when l_shipdate >= o_orderdate then l_shipdate end as filled_ts
       from lineitem join orders on l_orderkey = o_orderkey""",
)
DURATIONS = ("durations", "select *, coalesce(epoch(filled_ts - placed_ts), 100.0) as duration from fills")


@query(
    "calib_fill_time",
    S.chain(FILLS, DURATIONS) + f"select symbol, {S.rounded(chr(34) + 'offset' + chr(34), 'distance')}, placed_ts, {S.cols('duration')} from durations",
)
def calib_fill_time(spark, sf_dir):
    d = Q.fill_time(fixtures.fills(spark, sf_dir)).withColumnRenamed("offset", "distance")
    return present(d, "symbol", "distance", "placed_ts", "duration")


POINTS = (
    "points",
    """select symbol, "offset" as x, count(duration)::double as n, sum(duration) as d, sum(duration * duration) as dd
       from durations where "offset" is not null group by 1, 2 having count(duration) > 0""",
)


def decay_sql(offset: bool) -> str:
    """The best of the first rates, then halvings of its bracket by the sign of the error's slope.

    Rates are in units of one over the span of a symbol's distances. With offset the curve is
    (1 - exp(-r u)) / r in place of exp(-r u), which spans the same fits.
    """
    rates = ", ".join(repr(float(r)) for r in Q.RATES)
    far = max(map(abs, Q.RATES))
    at = """select p.symbol, s.rate, s.lo, s.hi, s.step, p.n, p.d, p.dd, x0, x1,
                   (x - case when s.rate >= 0 then x0 else x1 end) / case when x1 > x0 then x1 - x0 else 1.0 end as u
            from points p join {state} s using (symbol)"""
    if offset:
        small = f"abs(rate) < {Q.SERIES!r}"
        series = lambda k: " + ".join(f"pow(u, {j + 1}) * pow(rate, {j - k}) * {(-1.0) ** j * math.perm(j, k) / math.factorial(j + 1)!r}" for j in range(k, 7))
        curve = f"""select *, case when {small} then {series(1)} else (u * exp(-rate * u) - f) / rate end as g
                    from (select *, case when {small} then {series(0)} else (1 - exp(-rate * u)) / rate end as f from ({{at}}))"""
        mid = lambda xy, x, y: f"({xy} - {x} * {y} / n)"
    else:
        curve = "select *, exp(-rate * u) as f, -u * exp(-rate * u) as g from ({at})"
        mid = lambda xy, x, y: xy
    sums = """select symbol, rate, any_value(lo) as lo, any_value(hi) as hi, any_value(step) as step, any_value(x0) as x0, any_value(x1) as x1,
                     sum(n) as n, sum(d) as d, sum(dd) as dd, sum(n * f) as f, sum(n * g) as g, sum(d * f) as df, sum(d * g) as dg,
                     sum(n * f * f) as ff, sum(n * f * g) as fg from ({curve}) group by symbol, rate"""
    fit = f"""select *, df / nullif(ff, 0) as level, {"d * d / n +" if offset else ""} coalesce(df * df / nullif(ff, 0), 0) as explained,
                     sign(df) * (2 * dg * ff - df * 2 * fg) as slope, (d - coalesce(df / nullif(ff, 0), 0) * f0) / n as base
              from (select symbol, rate, lo, hi, step, x0, x1, n, d, dd, f as f0, {mid("ff", "f", "f")} as ff, {mid("fg", "f", "g")} as fg,
                           {mid("df", "f", "d")} as df, {mid("dg", "g", "d")} as dg from ({{sums}}))"""

    def fits(state: str) -> str:
        return fit.format(sums=sums.format(curve=curve.format(at=at.format(state=state))))

    shown = """select symbol, rate / case when x1 > x0 then x1 - x0 else 1.0 end as kappa, level, rate, base,
                      case when dd - explained > {near} * dd then dd - explained else 0.0 end as sse,
                      exp(rate / case when x1 > x0 then x1 - x0 else 1.0 end * case when rate >= 0 then x0 else x1 end) as far from found"""
    flat = "" if offset else " union all select symbol, 0.0, 0.0, 0.0, 0 from span where x1 = x0"
    return S.chain(
        FILLS, DURATIONS, POINTS,
        ("span", f"select symbol, min(x) as x0, max(x) as x1 from points group by 1 {'having count(x) > 2' if offset else ''}"),
        ("span_points", "select points.*, x0, x1 from points join span using (symbol)"),
        ("tried", f"select symbol, unnest([{rates}]::double[]) as rate, 0.0 as lo, 0.0 as hi, 0 as step from span where x1 > x0"),
        ("grid", fits("tried")),
        ("ranked", f"""select *, row_number() over (partition by symbol order by explained desc, abs(rate), rate desc) as r, max(explained) over (partition by symbol) as most,
                       max(case when abs(rate) >= {far!r} then explained end) over (partition by symbol) as far from grid"""),
        ("ordered", "select symbol, rate, lag(rate, 1, rate) over w as lo, lead(rate, 1, rate) over w as hi from grid window w as (partition by symbol order by rate)"),
        ("first", f"""select o.symbol, o.rate, o.lo, o.hi from ranked k join ordered o on o.symbol = k.symbol and o.rate = k.rate
                      where k.r = 1 and not (k.far >= k.most - {Q.NEAR!r} * k.dd and k.d <> 0)"""),
        ("halved", f"""select symbol, rate, lo, hi, 0 as step from first
                       union all
                       select symbol, (lo + hi) / 2, lo, hi, step + 1 from (
                           select symbol, step, case when slope >= 0 then rate else lo end as lo, case when slope > 0 then hi else rate end as hi
                           from ({fits("halved")}) where step < 90)"""),
        ("limits", f"""select symbol, arg_min(rate, struct_pack(a := abs(rate), b := -rate)) as rate from ranked
                       where far >= most - {Q.NEAR!r} * dd and explained >= most - {Q.NEAR!r} * dd and d <> 0 group by 1"""),
        ("ended", f"select symbol, rate, lo, hi, step from halved where step = 90 union all select symbol, rate, 0.0, 0.0, 0 from limits{flat}"),
        ("found", fits("ended")),
        ("fitted", shown.format(near=repr(Q.NEAR))),
    ).replace("with ", "with recursive ", 1).replace("from points p join", "from span_points p join")


@query("calib_decay_fit", decay_sql(False) + f"select symbol, {S.cols('kappa', 'a', 'sse')} from (select *, level * far as a from fitted)")
def calib_decay_fit(spark, sf_dir):
    return present(Q.decay_fit(Q.fill_time(fixtures.fills(spark, sf_dir))))


@query(
    "calib_decay_fit_offset",
    decay_sql(True) + f"select symbol, {S.cols('kappa', 'a', 'c', 'sse')} from (select *, -level / rate * far as a, base + level / rate as c from fitted)",
)
def calib_decay_fit_offset(spark, sf_dir):
    return present(Q.decay_fit(Q.fill_time(fixtures.fills(spark, sf_dir)), offset=True))


# ---- scenarios ---------------------------------------------------------------------------

SCENARIO = [
    *S.bars(HOUR),
    ("s1", f"select *, {VARIANCE[0][1]}, {S.pct('close')} as ret from bars"),
    ("s2", f"select * exclude (v0), coalesce(v0, 1e-7) as variance from (select *, {S.ma('sd5', 5)} as v0 from s1)"),
    ("s3", f"select *, {S.ma('ret', 10)} as drift, {S.ma('variance', 10)} as vol, lead(close) over {S.SEQ} as nx from s2"),
    ("s4", "select *, close as s0, row_number() over (partition by symbol order by bar_ts desc) as r from s3"),
]
RATE = "0.05375 / ((60.0 / 3600) * 420 * 252)"


@query(
    "scen_params",
    S.chain(*SCENARIO)
    + f"select symbol, bar_ts, {S.cols('s0', 'drift', 'vol')}, {S.rounded(RATE, 'rate')}, {S.rounded(f'exp(-({RATE}))', 'discount')} from s4 where r = 1",
)
def scen_params(spark, sf_dir):
    return present(C.params(stored(spark, sf_dir), HOUR))


@query(
    "scen_terminal_stats",
    S.chain(
        *SCENARIO,
        (
            "r",
            """select symbol, s0 * exp(drift) as mean, s0 * exp(drift) * sqrt(exp(vol * vol) - 1) as std,
                      s0 * exp(drift - vol * vol / 2 - 1.6448536269514722 * vol) as p05, s0 * exp(drift - vol * vol / 2) as p50,
                      s0 * exp(drift - vol * vol / 2 + 1.6448536269514722 * vol) as p95 from s4 where r = 1""",
        ),
    )
    + f"select symbol, {S.cols('mean', 'std', 'p05', 'p50', 'p95')} from r",
)
def scen_terminal_stats(spark, sf_dir):
    return present(C.terminal_stats(C.params(stored(spark, sf_dir), HOUR)))


@query(
    "scen_error",
    S.chain(*SCENARIO, ("r", f"select symbol, {fin('(close * exp(drift))')} - nx as miss from s3"))
    + f'select symbol, {S.rounded("avg(miss * miss)", "mse")}, count(miss) as bars from r group by 1',
)
def scen_error(spark, sf_dir):
    return present(C.error(stored(spark, sf_dir), HOUR))
