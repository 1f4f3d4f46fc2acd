"""Order, cancel and exit decisions as tables. Nothing here talks to a broker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.frames import Frame

OPEN_STATUS = ("O", "P")
CANCEL_REQUEST = 500  # orders one cancel request takes
LADDER = 10


def _cents(x: Column) -> Column:
    return F.round(x, 2)


def order_qty(risk: Column, base: float = 100.0) -> Column:
    """Order size, falling with inventory risk. base is 101 on the sell side."""
    return F.bround(base * F.exp(-5 * (risk - 0.019) / (1 - 0.019))).cast("long")  # half to even


def entries(desk: DataFrame) -> DataFrame:
    """Entry orders where a side's prediction is 1.

    Needs res, best_bid, best_ask, risk, pred_buy and pred_sell. Stop and target use the quoted
    spread; the limit price uses one that is widened when too tight.
    """
    res, bid, ask = F.col("res"), F.col("best_bid"), F.col("best_ask")
    buy = desk.filter("pred_buy = 1").select(
        "symbol",
        F.lit("BUY").alias("side"),
        _cents(res + F.when(bid > -0.01, bid - 0.05).otherwise(bid)).alias("limit_price"),
        (res + bid * 3).alias("take_profit"),
        (res - bid * 10).alias("stop_loss"),
        order_qty(F.col("risk"), 100.0).alias("qty"),
    )
    sell = desk.filter("pred_sell = 1").select(
        "symbol",
        F.lit("SELL").alias("side"),
        _cents(res + F.when(ask < 0.01, ask + 0.05).otherwise(ask)).alias("limit_price"),
        (res - ask * 3).alias("take_profit"),
        (res + ask * 10).alias("stop_loss"),
        order_qty(F.col("risk"), 101.0).alias("qty"),
    )
    return buy.unionByName(sell)


def bracket(orders: DataFrame) -> DataFrame:
    """Bracket orders ready to send: whole quantity, prices in cents."""
    return orders.select(
        "symbol",
        "side",
        F.col("qty").cast("long").alias("qty"),
        F.lit("limit").alias("type"),
        F.lit("bracket").alias("order_class"),
        F.lit("gtc").alias("time_in_force"),
        *[_cents(F.col(c)).alias(c) for c in ("limit_price", "take_profit", "stop_loss")],
    )


def cancels(orders: DataFrame, symbols: DataFrame, side: str | None = None, per_request: int = CANCEL_REQUEST) -> DataFrame:
    """Open orders of the symbols to cancel, of one side or both, newest first in numbered requests.

    All of them are cancelled: `request` is 1 for a symbol's newest `per_request` orders, 2 for the
    next ones, and so on. Positions are counted over ranges of the sorted orders, not per symbol.
    """
    live = orders.filter(F.col("status").isin(*OPEN_STATUS))
    live = live.filter(F.col("side") == side) if side else live
    live = live.join(symbols.select("symbol").distinct(), "symbol", "left_semi")
    f = Frame.ranged(live.withColumn("_newest", -F.col("order_id")), ("symbol",), ("_newest",)).positions()
    request = F.floor(F.col("pos") / per_request).cast("long") + 1
    return f.add(request=request).own().drop("_newest", "pos", "n")


def remaining(orders: DataFrame, cancelled: DataFrame) -> DataFrame:
    """Open orders that no cancel covers."""
    live = orders.filter(F.col("status").isin(*OPEN_STATUS))
    return live.join(cancelled.select("order_id"), "order_id", "left_anti")


def _exit_spread() -> Column:
    """The quoted spread a position exits with, widened when it is too tight."""
    bid, ask = F.col("best_bid"), F.col("best_ask")
    wide_bid = F.when(bid > -0.01, _cents(bid - 0.05)).otherwise(bid)
    wide_ask = F.when(ask < -0.01, _cents(ask + 0.05)).otherwise(ask)
    return F.when(F.col("side") == "SHORT", wide_bid).otherwise(wide_ask)


def match_ladder(positions: DataFrame, quotes: DataFrame) -> DataFrame:
    """Ten exit orders per position, at distances spaced evenly from 1 to the quantity."""
    short = F.col("side") == "SHORT"
    limit = _cents(_cents(F.col("res")) + _cents(_exit_spread()))
    way = F.when(short, -1.0).otherwise(1.0)
    rungs = (
        positions.select("symbol", "side", F.abs("qty_available").alias("_q"))
        .join(quotes.select("symbol", "res", "best_bid", "best_ask"), "symbol")
        .withColumn("_limit", limit)
        .withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(LADDER - 1))))
        .withColumn("_d", 1 + F.col("step") * (F.col("_q") - 1) / (LADDER - 1))
    )
    near = _cents(F.col("_limit") + way * F.col("_d"))
    return rungs.select(
        "symbol",
        "step",
        F.when(short, "BUY").otherwise("SELL").alias("order_side"),
        near.alias("limit_price"),
        near.alias("take_profit"),
        _cents(F.col("_limit") - way * F.col("_d")).alias("stop_loss"),
        F.abs("_d").alias("qty"),
    )


def match_single(positions: DataFrame, quotes: DataFrame) -> DataFrame:
    """One exit order per position: stop at 100 spreads, target at 3. Rounded prices are taken absolute.

    Only the limit starts from the absolute reservation price; stop and target keep its sign.
    """
    short = F.col("side") == "SHORT"
    way = F.when(short, 1.0).otherwise(-1.0)
    joined = (
        positions.select("symbol", "side", F.abs("qty_available").alias("qty"))
        .join(quotes.select("symbol", "res", "best_bid", "best_ask"), "symbol")
        .withColumn("_s", _exit_spread())
    )
    res, s = F.col("res"), F.col("_s")
    return joined.select(
        "symbol",
        F.when(short, "BUY").otherwise("SELL").alias("order_side"),
        F.abs(_cents(_cents(F.abs(res)) + _cents(s))).alias("limit_price"),
        F.abs(_cents(res - way * s * 3)).alias("take_profit"),
        F.abs(_cents(res + way * s * 100)).alias("stop_loss"),
        "qty",
    )


def _per_share() -> Column:
    return F.try_divide(F.col("unrealized_pl"), F.abs("qty"))


def take_profit(positions: DataFrame, loss_limit: float | None = -5.0) -> DataFrame:
    """Positions to close and why. loss_limit is None in the live form."""
    intraday = F.col("unrealized_intraday_pl")
    reason = F.when(_per_share() >= 0.06, "share_gain").when(intraday >= 6, "intraday_gain")
    if loss_limit is not None:
        reason = reason.when(intraday <= loss_limit, "intraday_loss")
    return positions.withColumn("reason", reason).filter("reason is not null")


def stop_rules(positions: DataFrame) -> DataFrame:
    """The older stop rules: loss per share, intraday loss, or distance from the entry price."""
    gap = F.col("avg_entry_price") - F.col("current_price")
    reason = (
        F.when(_per_share() <= -0.12, "share_loss")
        .when(F.col("unrealized_intraday_pl") <= -13, "intraday_loss")
        .when(F.col("side").isin("LONG", "SHORT") & ((gap <= -0.1) | (gap >= 0.1)), "distance")
    )
    return positions.withColumn("reason", reason).filter("reason is not null")


def session_close(checks: DataFrame, ts: str = "ts") -> DataFrame:
    """Checks that fall into the last minutes of the session, when everything is closed."""
    return checks.filter((F.hour(ts) > 21) & (F.minute(ts) > 57))
