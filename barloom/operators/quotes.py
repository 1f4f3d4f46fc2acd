"""Inventory-aware quote model: arrival rate, spreads, sensitivities, reservation price.

Symbols as in the formulas: s sigma, g gamma (inventory risk), q inventory, m mu, k depth decay,
a arrival rate. All but the inputs are projections, so they stay in generated code.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import rolling as R
from barloom.functions.numeric import _c, div, finite, ln, sanitize, sqrt
from barloom.operators.bars import last_bars
from barloom.operators.features import f_market_impact, f_sigma, f_variance
from barloom.operators.frames import BLOCK_ROWS, Frame
from barloom.session import materialize

ROOT2 = math.sqrt(2)
SESSION_MINUTES = 420.0
CLOSE_HOUR = 22


def inventory(df: DataFrame, positions: DataFrame) -> DataFrame:
    """Position size per symbol; rows of one symbol add up, and a symbol without a position counts as 1."""
    held = positions.groupBy("symbol").agg(F.sum(F.col("qty").cast("int")).cast("double").alias("_qty"))
    return df.join(held, "symbol", "left").withColumn("inventory", F.coalesce("_qty", F.lit(1.0))).drop("_qty")


def gamma(
    df: DataFrame,
    positions: DataFrame,
    rules: DataFrame | None = None,
    current_variance: Column | float = 0.3,
    fixed: float | None = None,
) -> DataFrame:
    """Inventory risk per symbol: |qty| / 1000 with a position, less than 0.01 without one.

    Rows of one symbol add up. Symbols with a rule `index` use |qty| / 100. `fixed` gives every symbol one value (the live
    form always ended at 0.002).
    """
    if fixed is not None:
        return df.withColumn("gamma", F.lit(float(fixed)))
    held = positions.groupBy("symbol").agg(F.abs(F.sum(F.col("qty").cast("int"))).cast("double").alias("_held"))
    df = df.join(held, "symbol", "left")
    if rules is not None:
        index = rules.groupBy("symbol").agg(F.max(F.when(F.col("rule") == "index", F.lit("index"))).alias("_rule"))
        df = df.join(index, "symbol", "left")
    else:
        df = df.withColumn("_rule", F.lit(None).cast("string"))
    variance = F.lit(current_variance) if isinstance(current_variance, float) else current_variance
    risk = (
        F.when(F.col("_held").isNull(), 0.01 * (1 - variance))
        .when(F.col("_rule") == "index", 0.01 * F.col("_held"))
        .otherwise(F.col("_held") / 1000)
    )
    return df.withColumn("gamma", risk).drop("_held", "_rule")


def arrival_stage(f: Frame, form: str = "batch", k0: float = 0.3) -> Frame:
    """k and the arrival proxies from volume means over 5 and 25 bars; looks 24 rows back."""
    f = f.roll(_v5=R.mean("volume", 5), _v25=R.mean("volume", 25))
    share = div("_v5", "_v25")
    if form == "live":
        # k0 enters, its arrival share comes out of the logarithm again as -k0 wherever volume is known.
        k = F.when(share > 0, F.lit(-float(k0)))
    else:
        k = ln(div(F.col("_v5"), ln("_v25")))
    f = f.add(k=k, _share=share)
    alpha = finite(F.col("_share") / F.exp("k"))
    return f.add(bid_alpha=alpha, ask_alpha=alpha).drop("_v5", "_v25", "_share")


def arrival(df: DataFrame, period: float, form: str = "batch", rows: int = BLOCK_ROWS) -> DataFrame:
    return arrival_stage(Frame.of(df, period, before=24, rows=rows), form).own()


def quote_inputs(df: DataFrame, period: float, rows: int = BLOCK_ROWS, extra: tuple[str, ...] = ()) -> DataFrame:
    """Bars with `inventory` and `gamma` to all inputs of the spreads: k, alphas, sigma, mu, impact.

    One frame, so one shuffle; k and the alphas are cleaned, sigma and mu keep their gaps.
    """
    f = Frame.of(df, period, before=24, rows=rows)
    f = f_market_impact.stage(f_sigma.stage(f))
    f = f_variance.stage(f)
    f = arrival_stage(f).roll(_o5=R.mean("open", 5))
    f = f.pct_change(_change=ln("_o5"))
    f = f.add(mu=F.abs(F.col("_change") / 2 * 10000)).drop("_o5", "_change")
    return f.put(**{c: sanitize(c) for c in ("k", "bid_alpha", "ask_alpha")}).own()


def fill_inputs(df: DataFrame) -> DataFrame:
    """Clean inputs of the sensitivities."""
    return df.withColumns({c: sanitize(c) for c in ("sigma", "mu", "k", "bid_alpha", "variance")})


def _growth(g: Column, k: Column) -> Column:
    """(1 + g/k) ^ (1 + k/g), NULL where the base is not positive or the power overflows."""
    base = 1 + F.try_divide(g, k)
    return finite(F.exp((1 + F.try_divide(k, g)) * ln(base)))


def _entry(g: Column, k: Column) -> Column:
    """ln(1 + g/k) / g"""
    return F.try_divide(ln(1 + F.try_divide(g, k)), g)


def spread_sym(df: DataFrame, scale: float = 1.0) -> DataFrame:
    """Spreads without drift. scale is 100000 in the live form."""
    s, g, q, k = (F.col(c) for c in ("sigma", "gamma", "inventory", "k"))
    width = lambda a: sqrt(finite(F.try_divide(s * s * g, 2 * k * F.col(a)) * _growth(g, k)))
    bid = _entry(g, k) + (2 * q + 1) / 2 * width("bid_alpha")
    ask = _entry(g, k) - (2 * q - 1) / 2 * width("ask_alpha")
    return df.withColumns({"bid_spread_aysm": finite(bid / scale), "ask_spread_aysm": finite(ask / scale)})


def _drift_spreads(g: Column) -> tuple[Column, Column]:
    s, q, k, m = (F.col(c) for c in ("sigma", "inventory", "k", "mu"))
    width = lambda a: sqrt(finite(F.try_divide(s * s * k, 2 * k * F.col(a)) * _growth(g, k)))
    drift = F.try_divide(m, g * s * s)
    bid = _entry(g, k) + (-drift + (2 * q + 1) / 2) * width("bid_alpha")
    ask = _entry(g, k) + (drift - (2 * q - 1) / 2) * width("ask_alpha")
    return bid, ask


def spread_drift(df: DataFrame, scale: float = 1000.0) -> DataFrame:
    """Spreads with drift, the ones used to quote. scale is 25000 in the live form."""
    bid, ask = _drift_spreads(F.col("gamma"))
    return df.withColumns({"bid_spread_aysm2": finite(bid / scale), "ask_spread_aysm2": finite(ask / scale)})


def spread_impact(df: DataFrame) -> DataFrame:
    """Spreads with a market-impact term."""
    s, g, q, k, i = (F.col(c) for c in ("sigma", "gamma", "inventory", "k", "market_impact"))
    growth = finite(F.exp((1 + k * g) * ln(1 + g * k)))
    width = lambda a: finite(F.exp(k / 4 * i)) * sqrt(finite(F.try_divide(s * 2 * g, 2 * k * F.col(a)) * growth))
    bid = _entry(g, k) + i / 2 + (2 * q + 1) / 2 * width("bid_alpha")
    ask = _entry(g, k) + i / 2 - (2 * q - 1) / 2 * width("ask_alpha")
    return df.withColumns({"bid_spread_aysm3": finite(bid), "ask_spread_aysm3": finite(ask)})


def _grid(start: float, count: int) -> Column:
    """start, 2 start, ... count start: a fixed number of values per row."""
    return F.explode(F.transform(F.sequence(F.lit(1), F.lit(count)), lambda j: j * F.lit(start)))


def _summary(df: DataFrame, value: str, *by: str) -> DataFrame:
    """describe() per group; each group is one parameter grid, so its size is fixed."""
    q = lambda p: F.percentile(value, F.lit(p))
    return df.groupBy(*by).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), q(0.25).alias("p25"), q(0.5).alias("p50"), q(0.75).alias("p75"),
        F.max(value).alias("max"),
    )


def gamma_sweep(df: DataFrame, count: int = 1000, start: float = 0.001) -> DataFrame:
    """Unscaled drift spreads of the last bar per symbol over a grid of gammas, summarised."""
    last = last_bars(df, 1).drop("gamma").withColumn("gamma", _grid(start, count))
    bid, ask = _drift_spreads(F.col("gamma"))
    sides = F.array(
        F.struct(F.lit("bid").alias("side"), finite(bid).alias("spread")),
        F.struct(F.lit("ask").alias("side"), finite(ask).alias("spread")),
    )
    long = last.select("symbol", F.explode(sides).alias("x")).select("symbol", "x.side", "x.spread")
    return _summary(long, "spread", "symbol", "side")


def _terms() -> dict[str, Column]:
    s, g, q, k, m, a = (F.col(c) for c in ("sigma", "gamma", "inventory", "k", "mu", "bid_alpha"))
    e = _growth(g, k)
    return {
        "s": s, "g": g, "q": q, "k": k, "m": m, "a": a, "E": e,
        "R": sqrt(finite(F.try_divide(e * s * s, a))),
        "Q": 0.5 * (1 - 2 * q) + F.try_divide(m, g * s * s),
        "L": ln(1 + F.try_divide(g, k)),
        "B": 1 + F.try_divide(g, k),
    }


def d_gamma(df: DataFrame) -> DataFrame:
    t = _terms()
    s, g, k, m, a, E, R, Q, L, B = (t[c] for c in ("s", "g", "k", "m", "a", "E", "R", "Q", "L", "B"))
    inner = F.try_divide(F.try_divide(k, g) + 1, k * B) - F.try_divide(k * L, g * g)
    value = (
        F.try_divide(s * s * E * inner * Q, 2 * ROOT2 * a * R)
        - F.try_divide(m * R, ROOT2 * g * g * s * s)
        - F.try_divide(L, g * g)
        + F.try_divide(F.lit(1.0), g * k * B)
    )
    return df.withColumn("inventory_risk_roc", finite(value))


def norm_series(df: DataFrame, period: float, column: str, out: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """A column scaled to -1..1 over its series."""
    f = Frame.of(df, period, rows=rows).carry(
        {"_lo": F.min(column), "_hi": F.max(column)},
        {"_min": lambda _, every: F.min("_lo").over(every), "_max": lambda _, every: F.max("_hi").over(every)},
    )
    scaled = 2 * div(F.col(column) - F.col("_min"), F.col("_max") - F.col("_min")) - 1
    return f.add(**{out: scaled}).drop("_min", "_max").own()


def d_inventory(df: DataFrame) -> DataFrame:
    return df.withColumn("inventory_derivative", -_terms()["R"] / ROOT2)


def d_sigma(df: DataFrame) -> DataFrame:
    t = _terms()
    s, g, m, a, E, R, Q = (t[c] for c in ("s", "g", "m", "a", "E", "R", "Q"))
    value = F.try_divide(E * Q * s, ROOT2 * a * R) - F.try_divide(ROOT2 * m * R, g * s * s * s)
    return df.withColumn("sigma_derivative", finite(value))


def d_k(df: DataFrame) -> DataFrame:
    t = _terms()
    s, g, k, a, E, R, Q, L, B = (t[c] for c in ("s", "g", "k", "a", "E", "R", "Q", "L", "B"))
    inner = F.try_divide(-g * (1 + F.try_divide(k, g)), B * k * k) + F.try_divide(L, g)
    value = F.try_divide(F.lit(-1.0), B * k * k) + F.try_divide(E * Q * s * s * inner, 2 * ROOT2 * a * R)
    return df.withColumn("k_derivative", finite(value))


def d_a(df: DataFrame) -> DataFrame:
    t = _terms()
    s, a, E, R, Q = (t[c] for c in ("s", "a", "E", "R", "Q"))
    return df.withColumn("a_derivative", finite(F.try_divide(-E * Q * s * s, 2 * ROOT2 * a * a * R)))


def integrals(df: DataFrame) -> DataFrame:
    t = _terms()
    s, g, q, m, a, R, L = (t[c] for c in ("s", "g", "q", "m", "a", "R", "L"))
    body = g * (1 - 2 * q) * s * s + 4 * m * ln(s)
    return df.withColumns(
        {
            "indefinite_integral": finite(F.try_divide(-R * body, 8 * ROOT2 * a * g * s)),
            "indefinite_integral2": finite(F.try_divide(8 * s * s * L + ROOT2 * R * body, 8 * g * s)),
        }
    )


def minutes_left(as_of: Column) -> Column:
    """Whole minutes from `as_of` to the close on the same day (half a minute goes to even)."""
    close = F.unix_micros(F.date_trunc("day", as_of)) + F.lit(CLOSE_HOUR * 3_600_000_000)
    return F.bround((close - F.unix_micros(as_of)) / 60_000_000.0)


def _reservation(mid: Column, q: Column, risk: Column, variance: Column, left: Column) -> Column:
    return mid - q * risk * (variance * 1000) * (1 - left / SESSION_MINUTES) / 40


def reservation(df: DataFrame, as_of: str, mid: str = "close") -> DataFrame:
    """Reservation price per symbol from its last bar. mid is d_vwap in the live form."""
    left = minutes_left(F.lit(as_of).cast("timestamp"))
    res = _reservation(F.col(mid), F.col("inventory"), F.col("gamma"), F.col("variance"), left)
    return last_bars(df, 1).withColumn("res", res)


def reservation_sweep(df: DataFrame, as_of: str, mid: str = "close", count: int = 1000, start: float = 0.0001) -> DataFrame:
    left = minutes_left(F.lit(as_of).cast("timestamp"))
    last = last_bars(df, 1).drop("gamma").withColumn("gamma", _grid(start, count))
    res = _reservation(F.col(mid), F.col("inventory"), F.col("gamma"), F.col("variance"), left)
    return _summary(last.withColumn("res", res), "res", "symbol")


UNFILLED = 100.0  # duration of an order that was never filled


def fill_time(fills: DataFrame) -> DataFrame:
    """Seconds from order to fill."""
    took = (F.unix_micros("filled_ts") - F.unix_micros("placed_ts")) / 1_000_000.0
    return fills.withColumn("duration", F.coalesce(took, F.lit(UNFILLED)))


RATES = (0.0, *(sign * 10 ** (j / 2) for j in range(-6, 7) for sign in (1, -1)))  # first rates tried, per span of distances
WIDEN = 100.0  # factor by which the outermost rates grow while they are best
WIDEST = 1e12
SERIES = 0.01  # least size that a step is measured by
LINE, TERMS = 0.5, 13  # with an offset, rates below this are summed as series of so many terms, as the closed forms cancel there
STEPS = 100
NEAR = 1e-12  # share of the squares that counts as nothing
STILL = 1e-13  # step, by the rate's size, at which a rate counts as found and is left alone
PART = 4096  # distances of a symbol that are met by one row of rates, about
FEW = 50_000  # rows of rates that are broadcast at most, a few MB; more of them meet the distances in a shuffle


def decay_fit(durations: DataFrame, offset: bool = False) -> DataFrame:
    """duration = A exp(-kappa x), or with `offset` A exp(-kappa x) + c: least squares over all orders of a symbol.

    For a given rate the rest is linear, so only the rate is searched, in units of one over the span
    of a symbol's distances. Rates of either sign and 0 are compared, further ones as long as the
    outermost is best; between the neighbours of the best one, Newton steps look for the rate where
    the error's slope is 0, and halve the bracket where a step would leave it. Every step is one
    aggregation over the distances of the symbols still open, in which orders enter as count, sum and
    sum of squares. Distances carry what is known of their symbol, so that rates are tried without a
    join; a symbol with many is dealt into parts, and its rate comes to each of them.

    Symbols need two distances (three with `offset`); those with one have rate 0 and no row with
    `offset`. Where the error falls for ever as the rate grows, the least of the rates compared is
    taken that comes within twelve digits of the limit. With `offset`, a straight line is rate 0 with
    null `a` and `c`. What is left of the error after rounding is 0.
    """
    d = F.col("duration")
    points = durations.groupBy("symbol", F.col("offset").alias("x")).agg(
        F.count(d).cast("double").alias("n"), F.sum(d).alias("d"), F.sum(d * d).alias("dd")
    )
    points = materialize(points.filter("n > 0 and x is not null"), "distances")
    # `mid` is near the mean duration, and short, so that taking it off the sums of a distance is exact
    mid = (F.sum("d") / F.sum("n")).cast("float").cast("double") if offset else F.lit(0.0)
    parts = F.ceil(F.count("x") / PART).cast("int")
    span = points.groupBy("symbol").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.count("x").alias("k"), parts.alias("parts"), mid.alias("mid"))
    span = materialize(span.filter("k > 2") if offset else span, "spans")
    part = F.pmod(F.xxhash64("x"), F.col("parts")).cast("int")
    points = materialize(points.join(span.drop("k").hint("merge"), "symbol").withColumn("part", part), "points")

    def tries(rates: Sequence[float]) -> DataFrame:
        """What each of the rates explains, for every symbol with a span."""
        p = points.filter("x1 > x0").withColumn("rate", F.explode(F.array(*[F.lit(r) for r in rates])))
        at = _slopes(_decay_sums(p, offset, ["parts"]), offset)
        return materialize(at.select("symbol", "parts", "rate", "d", "dd", "explained"), "rates")

    def sums(state: DataFrame, size: int, keep: list[str]) -> DataFrame:
        """Sums over the distances for each symbol of the state at its rate, and from them fit and slope of the error."""
        rates = state.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        return _slopes(_decay_sums(points.join(rates.hint("broadcast" if size <= FEW else "merge"), ["symbol", "part"]), offset, keep), offset)

    size = lambda state: state.agg(F.sum("parts")).first()[0] or 0
    tried = [float(r) for r in RATES]
    grid = tries(tried)
    while True:
        top = max(map(abs, tried))
        best = grid.groupBy("symbol").agg(
            F.max_by("rate", F.struct("explained", -F.abs("rate"), "rate")).alias("rate"), F.max("explained").alias("most"), F.max("dd").alias("all"),
            F.max(F.when(F.abs("rate") >= top, F.col("explained"))).alias("far"), F.max("d").alias("d"), F.max("parts").alias("parts"),
        )
        rising = (F.col("far") >= F.col("most") - NEAR * F.col("all")) & (F.col("d") != 0)
        if top >= WIDEST or best.filter(rising).isEmpty():
            break
        wider = [s * top * WIDEN ** (k / 4) for k in (1, 2, 3, 4) for s in (1.0, -1.0)]
        tried += wider
        grid = grid.union(tries(wider))
    order = sorted(tried)
    low = F.create_map(*[F.lit(float(x)) for pair in zip(order, [order[0], *order[:-1]], strict=True) for x in pair])
    high = F.create_map(*[F.lit(float(x)) for pair in zip(order, [*order[1:], order[-1]], strict=True) for x in pair])
    limit = grid.join(best.filter(rising).select("symbol", "most", "all").hint("merge"), "symbol").filter(F.col("explained") >= F.col("most") - NEAR * F.col("all"))
    limit = limit.groupBy("symbol", "parts").agg(F.min_by("rate", F.struct(F.abs("rate"), -F.col("rate"))).alias("rate"))
    best = best.filter(~rising).select("symbol", "parts", F.when(F.col("d") == 0, 0.0).otherwise(F.col("rate")).alias("rate"))
    best = best.withColumns({"lo": low[F.col("rate")], "hi": high[F.col("rate")]})
    state = materialize(best.withColumn("moved", F.lit(1.0)), "bracket")
    moving = F.col("moved") > STILL
    for _ in range(STEPS):
        left = size(state.filter(moving))
        if not left:
            break
        at = sums(state.filter(moving), left, ["parts", "lo", "hi"])
        lo, hi = F.when(F.col("slope") > 0, F.col("rate")).otherwise(F.col("lo")), F.when(F.col("slope") > 0, F.col("hi")).otherwise(F.col("rate"))
        newton = F.col("rate") - F.try_divide("slope", "curve")
        at = at.withColumns({"lo": lo, "hi": hi, "_to": newton})
        inside = (F.col("_to") > F.col("lo")) & (F.col("_to") < F.col("hi")) & (F.col("curve") < 0)
        still = (F.col("slope") == 0) | ((F.col("_to") == F.col("rate")) & (F.col("curve") < 0))  # else a rate found would leave for its bracket's middle
        to = F.when(still, F.col("rate")).when(inside, F.col("_to")).otherwise((F.col("lo") + F.col("hi")) / 2)
        moved = F.abs(to - F.col("rate")) / F.greatest(F.abs(to), F.lit(SERIES))
        at = at.select("symbol", "parts", to.alias("rate"), "lo", "hi", moved.alias("moved"))
        state = materialize(at.unionByName(state.filter(~moving.eqNullSafe(True))), "bracket")
    flat = span.filter("x1 = x0").select("symbol", "parts", F.lit(0.0).alias("rate"))
    done = state.select("symbol", "parts", "rate").unionByName(flat).unionByName(limit)
    done = sums(done, size(span), ["x0", "x1"])
    wide = F.when(F.col("x1") > F.col("x0"), F.col("x1") - F.col("x0")).otherwise(1.0)
    error = F.col("dd") - F.col("explained")
    done = done.withColumns({"kappa": F.col("rate") / wide, "sse": F.when(error > NEAR * F.col("dd"), error).otherwise(0.0)})
    far = F.exp(F.col("kappa") * _near_end())
    if not offset:
        return done.select("symbol", "kappa", (F.col("level") * far).alias("a"), "sse")
    line = F.abs("rate") < LINE
    a = F.when(line, F.try_divide(-F.col("level"), "rate")).otherwise(F.col("level")) * far
    c = F.when(line, F.col("base") + F.try_divide("level", "rate")).otherwise(F.col("base"))
    return done.select("symbol", "kappa", a.alias("a"), c.alias("c"), "sse")


def _near_end() -> Column:
    """The distance from which exp(-rate u) falls: the least for a rate from 0 on, else the greatest."""
    return F.when(F.col("rate") >= 0, F.col("x0")).otherwise(F.col("x1"))


def _decay_sums(points: DataFrame, offset: bool, keep: list[str]) -> DataFrame:
    """Sums per symbol and rate of the curve, its first two derivatives by the rate, and their products.

    `keep` are columns that a symbol has one value of at each rate.

    u is the distance from the near end by the span, so exp(-rate u) is 1 at most. The curve is
    e = exp(-rate u). With offset and near rate 0, where e is all but constant, (1 - e) / rate spans the
    same fits and is u at rate 0; at large rates that one in turn is all but a multiple of its
    derivative. With offset, durations enter less `mid`, so that no sum is much larger than what is left of it.
    """
    r, wide = F.col("rate"), F.when(F.col("x1") > F.col("x0"), F.col("x1") - F.col("x0")).otherwise(1.0)
    p = points.withColumn("u", (F.col("x") - _near_end()) / wide).withColumn("e", F.exp(-r * F.col("u")))
    u, e = F.col("u"), F.col("e")
    if offset:
        line, z = F.abs(r) < LINE, -r * u

        def series(k: int) -> Column:
            """The k-th derivative of (1 - e) / rate, by nested products from the last term on."""
            out = F.lit(0.0)
            for j in range(k + TERMS, k - 1, -1):
                out = out * z + math.perm(j, k) / math.factorial(j + 1)
            return out * (-1.0) ** k * F.pow(u, F.lit(float(k + 1)))

        p = p.withColumns({
            "f": F.when(line, series(0)).otherwise(e), "g": F.when(line, series(1)).otherwise(-u * e), "h": F.when(line, series(2)).otherwise(u * u * e),
        })
    else:
        p = p.withColumns({"f": e, "g": -u * e, "h": u * u * e})
    p = p.withColumn("y", F.col("d") - F.col("n") * F.col("mid"))
    n, d, y, f, g, h = (F.col(c) for c in ("n", "d", "y", "f", "g", "h"))
    return p.groupBy("symbol", "rate", *keep).agg(
        F.sum(n).alias("n"), F.sum(d).alias("d"), F.sum("dd").alias("dd"), F.sum(y).alias("y"),
        F.sum(n * f).alias("f"), F.sum(n * g).alias("g"), F.sum(n * h).alias("h"),
        F.sum(y * f).alias("yf"), F.sum(y * g).alias("yg"), F.sum(y * h).alias("yh"),
        F.sum(n * f * f).alias("ff"), F.sum(n * f * g).alias("fg"), F.sum(n * (g * g + f * h)).alias("gg"),
    )


def _slopes(s: DataFrame, offset: bool) -> DataFrame:
    """Level and base of the fit at each rate, what it explains of dd, and a factor of that one's slope with its derivative."""
    centred = lambda xy, x, y: F.col(xy) - F.col(x) * F.col(y) / F.col("n") if offset else F.col(xy)
    s = s.withColumns({
        "E": centred("ff", "f", "f"), "E1": 2 * centred("fg", "f", "g"),
        "E2": 2 * (F.col("gg") - (F.col("g") * F.col("g") + F.col("f") * F.col("h")) / F.col("n") if offset else F.col("gg")),
        "P": centred("yf", "f", "y"), "P1": centred("yg", "g", "y"), "P2": centred("yh", "h", "y"),
    })
    sign = F.signum("P")  # the slope of P^2 / E is a positive factor times sign * (2 P' E - P E')
    mean = F.col("d") * F.col("d") / F.col("n") if offset else F.lit(0.0)
    s = s.withColumns({
        "level": F.coalesce(F.try_divide("P", "E"), F.lit(0.0)), "slope": sign * (2 * F.col("P1") * F.col("E") - F.col("P") * F.col("E1")),
        "curve": sign * (2 * F.col("P2") * F.col("E") + F.col("P1") * F.col("E1") - F.col("P") * F.col("E2")),
    })
    return s.withColumns({
        "base": (F.col("d") - F.col("level") * F.col("f")) / F.col("n"), "explained": mean + F.coalesce(F.try_divide(F.col("P") * F.col("P"), F.col("E")), F.lit(0.0)),
    }).drop("E", "E1", "E2", "P", "P1", "P2")
