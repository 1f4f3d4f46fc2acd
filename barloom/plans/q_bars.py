"""Sources, bars and volume-weighted prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import bars as B
from barloom.plans import sqltext as S
from barloom.plans.catalog import DAY, FIVE_MINUTES, HOUR, present, query
from barloom.session import materialize, new_path
from barloom.sources import fixtures, trades as T

OHLC = ("open", "high", "low", "close")
OHLCV = (*OHLC, "volume")

RUNNING = "(partition by symbol order by ts, seq rows between unbounded preceding and current row)"
TICK_VWAP = (
    "ticks",
    f"""select *, sum(price * size) over {RUNNING} / nullif(sum(size) over {RUNNING}, 0) as d_vwap from trades""",
)


@query(
    "src_trades",
    S.chain(S.TRADES) + f"select symbol, ts, seq, {S.cols('price', 'size')} from trades where symbol in ('purchase', 'view')",
)
def src_trades(spark, sf_dir):
    return present(T.keep_symbols(fixtures.trades(spark, sf_dir), ["purchase", "view"]))


QUOTES_SQL = """select event_type as symbol, ts, value as bid,
    value * (1 + (cast(json_extract_string(props, '$.k') as double) + 1) / 10000) as ask,
    cast(json_extract_string(props, '$.k') as double) as volume from events"""


def _quotes_from_csv(spark, sf_dir):
    """Write the quotes as CSV and read them as the source operator does."""
    path = new_path(spark, "quotes-csv")
    fixtures.quotes(spark, sf_dir).write.option("header", True).option(
        "timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS"
    ).csv(path)
    return T.read_quotes_csv(spark, path)


@query("src_quote_csv", f"select symbol, ts, {S.cols('bid', 'ask', 'volume')} from ({QUOTES_SQL})")
def src_quote_csv(spark, sf_dir):
    q = _quotes_from_csv(spark, sf_dir)
    return present(q.withColumnRenamed("Bid", "bid").withColumnRenamed("Ask", "ask"))


@query("quote_mid", f"select symbol, ts, {S.cols('volume')}, {S.rounded('(bid + ask) / 2', 'close')} from ({QUOTES_SQL})")
def quote_mid(spark, sf_dir):
    return present(T.quote_mid(_quotes_from_csv(spark, sf_dir)))


@query(
    "src_bars_latest_good",
    S.chain(
        S.TRADES_DAILY,
        (
            "snaps",
            """select symbol, ts as snapshot_ts, avg(price) * (case when max(size) > 45 then 2.0 else 1.0 end) as open,
                      max(price) as high, min(price) as low, avg(price) as close, sum(size) as volume
               from trades_daily group by 1, 2""",
        ),
        (
            "good",
            """select *, row_number() over (partition by symbol order by snapshot_ts desc) as r from snaps
               where open is not null and close is not null and low > 0 and low <= least(open, close)
                 and high >= greatest(open, close) and volume > 0""",
        ),
    )
    + f"select symbol, snapshot_ts, {S.cols(*OHLCV)} from good where r = 1",
)
def src_bars_latest_good(spark, sf_dir):
    return present(T.latest_good_bars(fixtures.bar_snapshots(spark, sf_dir)))


@query("bars_ohlc", S.chain(S.TRADES, S.sparse(FIVE_MINUTES)) + f"select {S.keyed(*OHLC)} from sparse")
def bars_ohlc(spark, sf_dir):
    return present(B.bars_ohlc(fixtures.trades(spark, sf_dir), FIVE_MINUTES))


@query("bars_volume", S.chain(*S.bars(FIVE_MINUTES)) + f"select {S.keyed('volume')} from bars")
def bars_volume(spark, sf_dir):
    return present(B.bars_volume(fixtures.trades(spark, sf_dir), FIVE_MINUTES))


VWAP_MEAN_SQL = (
    "means",
    "select symbol, time_bucket(interval '300 seconds', ts) as bar_ts, avg(d_vwap) as d_vwap from ticks group by 1, 2",
)


@query("bars_vwap_mean", S.chain(S.TRADES, TICK_VWAP, VWAP_MEAN_SQL) + f"select {S.keyed('d_vwap')} from means")
def bars_vwap_mean(spark, sf_dir):
    return present(B.bars_mean(B.vwap_trade(fixtures.trades(spark, sf_dir)), FIVE_MINUTES))


@query(
    "bars_grid",
    S.chain(*S.bars(FIVE_MINUTES))
    + f"""select symbol, bar_ts, {S.cols(*OHLC)}, {S.rounded('coalesce(volume, 0)', 'volume')}
          from grid left join sparse using (symbol, bar_ts)""",
)
def bars_grid(spark, sf_dir):
    return present(B.bars_grid(B.trade_bars(fixtures.trades(spark, sf_dir), FIVE_MINUTES), FIVE_MINUTES))


@query(
    "bars_merge",
    S.chain(S.TRADES, TICK_VWAP, VWAP_MEAN_SQL, S.sparse(FIVE_MINUTES))
    + f"select {S.keyed(*OHLCV, 'd_vwap')} from sparse left join means using (symbol, bar_ts)",
)
def bars_merge(spark, sf_dir):
    t = fixtures.trades(spark, sf_dir)
    both = B.trade_bars(t, FIVE_MINUTES)
    vwap = B.bars_mean(B.vwap_trade(t), FIVE_MINUTES)
    return present(B.bars_merge(both.drop("volume"), both.select("symbol", "bar_ts", "volume"), vwap), "symbol", "bar_ts", *OHLCV, "d_vwap")


@query("bars_ffill", S.chain(*S.bars(FIVE_MINUTES)) + f"select {S.keyed(*OHLCV)} from bars")
def bars_ffill(spark, sf_dir):
    return present(B.bars(fixtures.trades(spark, sf_dir), FIVE_MINUTES))


UPSERT_SPLIT = "2024-01-15 12:20:00"


@query(
    "bars_upsert",
    S.chain(
        S.TRADES,
        ("trades_old", f"select * from trades where ts < timestamp '{UPSERT_SPLIT}'"),
        ("trades_new", f"select * from trades where ts >= timestamp '{UPSERT_SPLIT}' - interval '1 day'"),
        ("old_bars", S.sparse(HOUR, "trades_old")[1]),
        ("new_bars", S.sparse(HOUR, "trades_new")[1]),
    )
    + "select symbol, bar_ts, "
    + ", ".join(S.rounded(f"coalesce(n.{c}, o.{c})", c) for c in OHLCV)
    + " from new_bars n full outer join old_bars o using (symbol, bar_ts)",
)
def bars_upsert(spark, sf_dir):
    t = fixtures.trades(spark, sf_dir)
    split = F.lit(UPSERT_SPLIT).cast("timestamp")
    old = t.filter(F.col("ts") < split)
    new = t.filter(F.col("ts") >= split - F.expr("interval 1 day"))
    return present(B.bars_upsert(B.trade_bars(new, HOUR), B.trade_bars(old, HOUR)))


@query(
    "label_align",
    S.chain(*S.bars(HOUR), ("labels_", f"select symbol, bar_ts, close, lead(close) over {S.SEQ} as nx from bars"))
    + f"select {S.keyed(*OHLCV)} from bars b where exists (select 1 from labels_ l where l.symbol = b.symbol and l.bar_ts = b.bar_ts and l.nx is not null and (l.close <> 0 or l.nx <> 0))",
)
def label_align(spark, sf_dir):
    from barloom.operators.labels import labels

    b = B.bars(fixtures.trades(spark, sf_dir), HOUR)
    return present(B.align(b, labels(b, HOUR)))


@query(
    "last_bars",
    S.chain(*S.bars(FIVE_MINUTES), ("ranked", f"select *, row_number() over (partition by symbol order by bar_ts desc) as r from bars"))
    + f"select {S.keyed(*OHLCV)} from ranked where r <= 2",
)
def last_bars(spark, sf_dir):
    return present(B.last_bars(B.bars(fixtures.trades(spark, sf_dir), FIVE_MINUTES), 2))


@query("vwap_trade", S.chain(S.TRADES, TICK_VWAP) + f"select symbol, ts, seq, {S.cols('price', 'size', 'd_vwap')} from ticks")
def vwap_trade(spark, sf_dir):
    return present(B.vwap_trade(fixtures.trades(spark, sf_dir)))


def vwap_sql(value: str) -> str:
    return f"sum(volume * {value}) over {S.CUM} / nullif(sum(volume) over {S.CUM}, 0)"


@query("vwap_hl", S.chain(*S.bars(HOUR), ("v", f"select symbol, bar_ts, {vwap_sql('(high + low) / 2')} as vwap from bars")) + f"select {S.keyed('vwap')} from v")
def vwap_hl(spark, sf_dir):
    return present(B.vwap_hl(materialize(B.bars(fixtures.trades(spark, sf_dir), HOUR)), HOUR), "symbol", "bar_ts", "vwap")


@query("vwap_bar_open", S.chain(*S.bars(HOUR), ("v", f"select symbol, bar_ts, {vwap_sql('open')} as d_vwap from bars")) + f"select {S.keyed('d_vwap')} from v")
def vwap_bar_open(spark, sf_dir):
    return present(B.vwap_bar_open(materialize(B.bars(fixtures.trades(spark, sf_dir), HOUR)), HOUR), "symbol", "bar_ts", "d_vwap")


@query(
    "vwap_current",
    S.chain(S.TRADES, TICK_VWAP, VWAP_MEAN_SQL, ("r", "select *, row_number() over (partition by symbol order by bar_ts desc) as r from means"))
    + f"select {S.keyed('d_vwap')} from r where r = 1",
)
def vwap_current(spark, sf_dir):
    ticks = B.vwap_trade(fixtures.trades(spark, sf_dir))
    return present(B.vwap_current(B.bars_mean(ticks, FIVE_MINUTES)), "symbol", "bar_ts", "d_vwap")
