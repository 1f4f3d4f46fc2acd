"""Labels, splits, metrics and decision tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import decisions as D
from barloom.operators import labels as L
from barloom.plans import sqltext as S
from barloom.plans.catalog import HOUR, present, query
from barloom.plans.q_features import hourly, stored
from barloom.plans.q_quotes import POSITIONS
from barloom.session import new_path
from barloom.sources import fixtures
from barloom.sources.sinks import write_orders

LABELLED = [
    *S.bars(HOUR),
    ("n1", f"select *, lead(close) over {S.SEQ} as nx from bars"),
    (
        "n2",
        """select *, nx / nullif(close, 0) - 1 as future_return,
               case when close = 0 then sign(nx) else sign(nx / close - 1) end as up
           from n1 where nx is not null and (close <> 0 or nx <> 0)""",
    ),
    ("n3", "select *, case when up > 0 then 1 else 0 end as label_buy, case when up < 0 then 1 else 0 end as label_sell from n2"),
]


@query("label_future_return", S.chain(*LABELLED) + f"select {S.keyed('future_return')} from n3")
def label_future_return(spark, sf_dir):
    return present(L.labels(hourly(spark, sf_dir), HOUR), "symbol", "bar_ts", "future_return")


@query("label_buy", S.chain(*LABELLED) + "select symbol, bar_ts, label_buy from n3")
def label_buy(spark, sf_dir):
    return present(L.labels(hourly(spark, sf_dir), HOUR), "symbol", "bar_ts", "label_buy")


@query("label_sell", S.chain(*LABELLED) + "select symbol, bar_ts, label_sell from n3")
def label_sell(spark, sf_dir):
    return present(L.labels(hourly(spark, sf_dir), HOUR), "symbol", "bar_ts", "label_sell")


COUNTED = ("p0", f"select *, row_number() over {S.SEQ} - 1 as pos, count(*) over {S.ALL} as n from bars")


@query(
    "split_time",
    S.chain(
        *S.bars(HOUR),
        COUNTED,
        ("p1", "select *, cast(round_even(n / 2.0, 0) as bigint) as half from p0"),
        ("p2", "select *, half - ceil(half * cast(0.55 as double)) as train, greatest(n - half - 1, 0) as rest from p1"),
    )
    + """select symbol, bar_ts, case when pos < train then 'train' when pos < half then 'test' when pos = half then 'gap'
             when pos <= half + (rest - ceil(rest * cast(0.35 as double))) then 'valid' else 'valid2' end as split from p2""",
)
def split_time(spark, sf_dir):
    return present(L.split_time(stored(spark, sf_dir), HOUR), "symbol", "bar_ts", "split")


@query(
    "split_time_live",
    S.chain(*S.bars(HOUR), COUNTED, ("p1", "select *, n - ceil(n * 0.5) as train, ceil(n * 0.5) as rest from p0"))
    + """select symbol, bar_ts, case when pos < train then 'train' when pos < train + rest - ceil(rest * 0.5) then 'valid'
             else 'test' end as split from p1""",
)
def split_time_live(spark, sf_dir):
    return present(L.split_time(stored(spark, sf_dir), HOUR, form="live"), "symbol", "bar_ts", "split")


@query(
    "split_forward_folds",
    S.chain(
        *S.bars(HOUR),
        COUNTED,
        ("p1", "select *, floor(n / 4) as size, k as fold, n - floor(n / 4) * (3 - k) as first from p0, range(0, 3) t(k)"),
        (
            "p2",
            """select *, case when pos >= first and pos < first + size then 'test' when pos < first - 1 then 'train' end as role
               from p1""",
        ),
    )
    + "select symbol, bar_ts, cast(fold as int) as fold, role from p2 where role is not null",
)
def split_forward_folds(spark, sf_dir):
    return present(L.forward_folds(stored(spark, sf_dir), HOUR, 3, 1), "symbol", "bar_ts", "fold", "role")


PREDICTED = [
    *S.bars(HOUR),
    ("n1", f"select *, lead(close) over {S.SEQ} as nx, lag(close) over {S.SEQ} as pv from bars"),
    (
        "preds",
        """select symbol, bar_ts, case when nx / nullif(close, 0) - 1 > 0 then 1 else 0 end as y,
                  case when close / nullif(pv, 0) - 1 > 0 then 1 else 0 end as pred from n1 where nx is not null""",
    ),
]


@query(
    "eval_metrics",
    S.chain(
        *PREDICTED,
        (
            "c",
            """select symbol, count(*) filter (where y = 1 and pred = 1) as tp, count(*) filter (where y = 0 and pred = 0) as tn,
                      count(*) filter (where y = 0 and pred = 1) as fp, count(*) filter (where y = 1 and pred = 0) as fn from preds group by 1""",
        ),
    )
    + f"""select symbol, {S.rounded('(tp + tn) / (tp + tn + fp + fn)', 'accuracy')},
          {S.rounded('(2.0 * tp / (2 * tp + fp + fn) + 2.0 * tn / (2 * tn + fp + fn)) / 2', 'f1_macro')} from c""",
)
def eval_metrics(spark, sf_dir):
    return present(L.metrics(L.naive_predictions(hourly(spark, sf_dir), HOUR), "symbol"))


@query(
    "eval_confusion",
    S.chain(*PREDICTED)
    + """select symbol, y, count(*) filter (where pred = 0) as pred_0, count(*) filter (where pred = 1) as pred_1
         from preds group by 1, 2""",
)
def eval_confusion(spark, sf_dir):
    return L.confusion(L.naive_predictions(hourly(spark, sf_dir), HOUR), "symbol")


# ---- orders ------------------------------------------------------------------------------

DESK = [
    *POSITIONS,
    (
        "desk",
        """select symbol, current_price as res, -abs(current_price - prior_price) / 100000 as best_bid,
                  abs(current_price - prior_price) / 100000 as best_ask, abs(qty) / 1000 as risk,
                  case when current_price > prior_price then 1 else 0 end as pred_buy,
                  case when current_price > prior_price then 0 else 1 end as pred_sell from positions""",
    ),
]
SIZE = lambda base: f"cast(round_even({base} * exp(-5 * (risk - 0.019) / (1 - 0.019)), 0) as bigint)"
ENTRIES = [
    *DESK,
    (
        "entries",
        f"""select symbol, 'BUY' as side, round(res + case when best_bid > -0.01 then best_bid - 0.05 else best_bid end, 2) as limit_price,
               res + best_bid * 3 as take_profit, res - best_bid * 10 as stop_loss, {SIZE(100.0)} as qty from desk where pred_buy = 1
        union all
        select symbol, 'SELL', round(res + case when best_ask < 0.01 then best_ask + 0.05 else best_ask end, 2),
               res - best_ask * 3, res + best_ask * 10, {SIZE(101.0)} from desk where pred_sell = 1""",
    ),
]
PRICES = ("limit_price", "take_profit", "stop_loss")
BRACKET_SQL = f"""select symbol, side, qty, 'limit' as type, 'bracket' as order_class, 'gtc' as time_in_force,
    {', '.join(S.rounded(f'round({c}, 2)', c) for c in PRICES)} from entries"""


@query("ord_entry", S.chain(*ENTRIES) + f"select symbol, side, qty, {S.cols(*PRICES)} from entries")
def ord_entry(spark, sf_dir):
    return present(D.entries(fixtures.desk(spark, sf_dir)))


@query("ord_qty", S.chain(*DESK) + f"select symbol, {SIZE(100.0)} as qty_buy, {SIZE(101.0)} as qty_sell from desk")
def ord_qty(spark, sf_dir):
    risk = F.col("risk")
    return fixtures.desk(spark, sf_dir).select(
        "symbol", D.order_qty(risk, 100.0).alias("qty_buy"), D.order_qty(risk, 101.0).alias("qty_sell")
    )


@query("ord_bracket", S.chain(*ENTRIES) + BRACKET_SQL)
def ord_bracket(spark, sf_dir):
    return present(D.bracket(D.entries(fixtures.desk(spark, sf_dir))))


@query("sink_orders", S.chain(*ENTRIES) + BRACKET_SQL)
def sink_orders(spark, sf_dir):
    path = new_path(spark, "orders")
    write_orders(D.bracket(D.entries(fixtures.desk(spark, sf_dir))), path)
    return present(spark.read.parquet(path))


ORDERS = (
    "open_orders",
    """select o_orderkey as order_id, 'C' || o_custkey as symbol, case when o_orderkey % 2 = 0 then 'buy' else 'sell' end as side,
              o_orderstatus as status, o_totalprice as limit_price from orders""",
)
CANCELLING = ("cancelling", "select 'C' || c_custkey as symbol from customer where c_mktsegment = 'BUILDING'")


def cancels_sql(side: str | None) -> tuple[str, str]:
    only = f"and side = '{side}'" if side else ""
    return (
        "cancels",
        f"""select *, (row_number() over (partition by symbol order by order_id desc) - 1) // 500 + 1 as request from open_orders
            where status in ('O', 'P') {only} and symbol in (select symbol from cancelling)""",
    )


OPEN_OUT = f"select order_id, symbol, side, status, {S.cols('limit_price')} from "
OPEN_COLS = ("order_id", "symbol", "side", "status", "limit_price")
CANCEL_OUT = f"select order_id, symbol, side, status, request, {S.cols('limit_price')} from "
CANCEL_COLS = (*OPEN_COLS, "request")


@query("ord_cancel_symbol", S.chain(ORDERS, CANCELLING, cancels_sql(None)) + CANCEL_OUT + "cancels")
def ord_cancel_symbol(spark, sf_dir):
    c = D.cancels(fixtures.open_orders(spark, sf_dir), fixtures.cancel_symbols(spark, sf_dir))
    return present(c, *CANCEL_COLS)


@query("ord_cancel_side", S.chain(ORDERS, CANCELLING, cancels_sql("sell")) + CANCEL_OUT + "cancels")
def ord_cancel_side(spark, sf_dir):
    c = D.cancels(fixtures.open_orders(spark, sf_dir), fixtures.cancel_symbols(spark, sf_dir), side="sell")
    return present(c, *CANCEL_COLS)


@query(
    "ord_remaining",
    S.chain(ORDERS, CANCELLING, cancels_sql("sell"))
    + OPEN_OUT
    + "open_orders o where status in ('O', 'P') and not exists (select 1 from cancels c where c.order_id = o.order_id)",
)
def ord_remaining(spark, sf_dir):
    orders = fixtures.open_orders(spark, sf_dir)
    c = D.cancels(orders, fixtures.cancel_symbols(spark, sf_dir), side="sell")
    return present(D.remaining(orders, c), *OPEN_COLS)


# ---- exits -------------------------------------------------------------------------------

EXIT = [
    *DESK,
    (
        "ex",
        """select p.symbol, p.side, abs(p.qty_available) as q, d.res,
                  case when p.side = 'SHORT' then case when best_bid > -0.01 then round(best_bid - 0.05, 2) else best_bid end
                       else case when best_ask < -0.01 then round(best_ask + 0.05, 2) else best_ask end end as spr
           from positions p join desk d using (symbol)""",
    ),
    ("lim", "select *, round(round(res, 2) + round(spr, 2), 2) as lim, case when side = 'SHORT' then -1.0 else 1.0 end as way from ex"),
]


@query(
    "pos_match_ladder",
    S.chain(*EXIT, ("rungs", "select *, cast(j as int) as step, 1 + j * (q - 1) / 9 as d from lim, range(0, 10) t(j)"))
    + f"""select symbol, step, case when side = 'SHORT' then 'BUY' else 'SELL' end as order_side,
          {S.rounded('round(lim + way * d, 2)', 'limit_price')}, {S.rounded('round(lim + way * d, 2)', 'take_profit')},
          {S.rounded('round(lim - way * d, 2)', 'stop_loss')}, {S.rounded('abs(d)', 'qty')} from rungs""",
)
def pos_match_ladder(spark, sf_dir):
    return present(D.match_ladder(fixtures.positions(spark, sf_dir), fixtures.desk(spark, sf_dir)))


@query(
    "pos_match_single",
    S.chain(*EXIT)
    + f"""select symbol, case when side = 'SHORT' then 'BUY' else 'SELL' end as order_side,
          {S.rounded('abs(round(round(abs(res), 2) + round(spr, 2), 2))', 'limit_price')},
          {S.rounded('abs(round(res + way * spr * 3, 2))', 'take_profit')},
          {S.rounded('abs(round(res - way * spr * 100, 2))', 'stop_loss')}, {S.rounded('q', 'qty')} from lim""",
)
def pos_match_single(spark, sf_dir):
    return present(D.match_single(fixtures.positions(spark, sf_dir), fixtures.desk(spark, sf_dir)))


PNL = ("qty", "unrealized_pl", "unrealized_intraday_pl")
TAKE = """case when unrealized_pl / nullif(abs(qty), 0) >= 0.06 then 'share_gain' when unrealized_intraday_pl >= 6 then 'intraday_gain'
    when unrealized_intraday_pl <= -5 then 'intraday_loss' end"""


@query(
    "pos_take_profit",
    S.chain(*POSITIONS, ("r", f"select *, {TAKE} as reason from positions"))
    + f"select symbol, side, reason, {S.cols(*PNL)} from r where reason is not null",
)
def pos_take_profit(spark, sf_dir):
    return present(D.take_profit(fixtures.positions(spark, sf_dir)), "symbol", "side", "reason", *PNL)


STOP = """case when unrealized_pl / nullif(abs(qty), 0) <= -0.12 then 'share_loss' when unrealized_intraday_pl <= -13 then 'intraday_loss'
    when avg_entry_price - current_price <= -0.1 or avg_entry_price - current_price >= 0.1 then 'distance' end"""


@query(
    "pos_stop_rules",
    S.chain(*POSITIONS, ("r", f"select *, {STOP} as reason from positions"))
    + f"select symbol, side, reason, {S.cols(*PNL)} from r where reason is not null",
)
def pos_stop_rules(spark, sf_dir):
    return present(D.stop_rules(fixtures.positions(spark, sf_dir)), "symbol", "side", "reason", *PNL)


@query(
    "pos_session_close",
    S.chain(S.TRADES) + "select distinct symbol, ts from trades where hour(ts) > 21 and minute(ts) > 57",
)
def pos_session_close(spark, sf_dir):
    checks = fixtures.trades(spark, sf_dir).select("symbol", "ts").distinct()
    return present(D.session_close(checks))
