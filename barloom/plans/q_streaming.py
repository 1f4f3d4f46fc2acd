"""Streaming queries, driven over files of trades with availableNow."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.plans import sqltext as S
from barloom.plans.catalog import FIVE_MINUTES, HOUR, present, query
from barloom.plans.q_bars import OHLCV
from barloom.plans.q_decisions import PNL, TAKE
from barloom.plans.q_features import hourly, rsi_sql
from barloom.plans.q_quotes import POSITIONS
from barloom.session import new_path
from barloom.sources import fixtures
from barloom.streaming import queries as Q

EDGES = ("2024-01-08", "2024-01-15", "2024-01-22")


def write_chunks(df, column="ts", key="symbol"):
    """Write rows as time-ordered groups of files; rows of one key and group share a file."""
    path = new_path(df.sparkSession, "stream-in")
    t, cuts = F.col(column), [F.lit(e).cast("timestamp") for e in EDGES]
    bounds = [t < cuts[0], (t >= cuts[0]) & (t < cuts[1]), (t >= cuts[1]) & (t < cuts[2]), t >= cuts[2]]
    for inside in bounds:
        df.filter(inside).repartition(2, key).write.mode("append").parquet(path)
    return path


def trade_files(spark, sf_dir):
    return write_chunks(fixtures.trades(spark, sf_dir))


def into_files(spark, stream):
    out = new_path(spark, "stream-out")
    Q.run(stream, new_path(spark, "stream-state"), path=out)
    return spark.read.parquet(out)


@query("stream_src_trades", S.chain(S.TRADES) + f"select symbol, ts, seq, {S.cols('price', 'size')} from trades")
def stream_src_trades(spark, sf_dir):
    return present(into_files(spark, Q.trade_stream(spark, trade_files(spark, sf_dir))))


CLOSED = "bar_ts + interval '300 seconds' <= (select max(ts) from trades) - interval '6 hours'"


@query("stream_bars", S.chain(S.TRADES, S.sparse(FIVE_MINUTES)) + f"select {S.keyed(*OHLCV)} from sparse where {CLOSED}")
def stream_bars(spark, sf_dir):
    trades = Q.trade_stream(spark, trade_files(spark, sf_dir), files_per_trigger=2)
    return present(into_files(spark, Q.stream_bars(trades, FIVE_MINUTES, "6 hours")))


@query(
    "stream_vwap",
    S.chain(S.TRADES)
    + f"select symbol, {S.rounded('sum(price * size)', 'turnover')}, {S.rounded('sum(size)', 'volume')}, "
    + f"{S.rounded('sum(price * size) / sum(size)', 'vwap')} from trades group by 1",
)
def stream_vwap(spark, sf_dir):
    out = new_path(spark, "vwap-log")
    trades = Q.trade_stream(spark, trade_files(spark, sf_dir))
    Q.run(Q.stream_vwap(trades), new_path(spark, "stream-state"), each=Q.batch_writer(out), mode="update")
    return present(Q.newest_rows(spark, out, "symbol"))


@query(
    "stream_upsert_bars",
    S.chain(S.TRADES, S.sparse(HOUR)) + f"select {S.keyed(*OHLCV)} from sparse",
)
def stream_upsert_bars(spark, sf_dir):
    """Bars are revised in every micro-batch that touches them; the kept table has the last form."""
    out = new_path(spark, "kept-bars")
    trades = Q.trade_stream(spark, trade_files(spark, sf_dir), files_per_trigger=2)
    # In update mode each bar is sent again whenever it changes; nothing is late with so long a delay.
    bars = Q.stream_bars(trades, HOUR, "60 days")
    Q.run(bars, new_path(spark, "stream-state"), each=Q.upsert_writer(spark, out, bars), mode="update")
    return present(Q.kept_bars(bars, out))


@query("stream_rsi", rsi_sql(14, ("close",), "bars").replace("as rsi_close", "as rsi"))
def stream_rsi(spark, sf_dir):
    b = hourly(spark, sf_dir)
    path = write_chunks(b, "bar_ts")
    bars = spark.readStream.schema(b.schema).option("maxFilesPerTrigger", 2).parquet(path)
    return present(into_files(spark, Q.stream_rsi(bars, "close", 14)))


@query(
    "stream_exit_signals",
    S.chain(*POSITIONS, ("r", f"select *, {TAKE} as reason from positions"))
    + f"select symbol, side, reason, {S.cols(*PNL)} from r where reason is not null",
)
def stream_exit_signals(spark, sf_dir):
    path = new_path(spark, "positions-in")
    p = fixtures.positions(spark, sf_dir)
    p.write.parquet(path)
    stream = spark.readStream.schema(p.schema).parquet(path)
    return present(into_files(spark, Q.stream_exit_signals(stream)), "symbol", "side", "reason", *PNL)


LATE = "size > 90 and ts < timestamp '2024-01-20'"  # trades that are reported after all others
FIRST = "ts < timestamp '2024-01-25'"


@query(
    "stream_late_data",
    S.chain(
        ("all_trades", S.TRADES[1]),
        ("seen", f"select *, {LATE} as late, {FIRST} as early from all_trades"),
        (
            "mark",
            """select max(ts) filter (where early) - interval '10 days' as dropped,
                      max(ts) - interval '10 days' as closed from seen where not late""",
        ),
        (
            "trades",
            """select s.* from seen s, mark where not late
               or time_bucket(interval '3600 seconds', ts) + interval '3600 seconds' > dropped""",
        ),
        S.sparse(HOUR),
    )
    + f"select {S.keyed(*OHLCV)} from sparse, mark where bar_ts + interval '3600 seconds' <= closed",
)
def stream_late_data(spark, sf_dir):
    """Trades in three micro-batches, the last of them late.

    A micro-batch drops what is older than the watermark of the batch before it. For the late one
    that is the watermark set by the first batch.
    """
    t = fixtures.trades(spark, sf_dir)
    path = new_path(spark, "late-in")
    for rows in (f"not ({LATE}) and {FIRST}", f"not ({LATE}) and not ({FIRST})", LATE):
        t.filter(rows).repartition(2, "symbol").write.mode("append").parquet(path)
    trades = Q.trade_stream(spark, path, files_per_trigger=2)
    return present(into_files(spark, Q.stream_bars(trades, HOUR, "10 days")))
