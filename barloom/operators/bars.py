"""Time bars from trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import div
from barloom.operators.frames import BLOCK_ROWS, Frame, grid_index, grid_time, micros

PRICES = ("open", "high", "low", "close")


def _order_key(period: float, seq_bits: int | None) -> Column:
    """What ranks two trades of one bar: time, then sequence number.

    A struct is always right but makes Spark aggregate by sorting. When sequence numbers are known
    to fit `seq_bits`, both parts fit one long and the aggregation hashes, about three times faster.
    A number that does not fit stops the job rather than give a wrong bar.
    """
    if seq_bits is None:
        return F.struct("ts", "seq")
    if micros(period).bit_length() + seq_bits > 63:
        raise ValueError("period and seq_bits do not fit one long")
    fits = (F.col("seq") >= 0) & (F.col("seq") < F.lit(1 << seq_bits))
    offset = F.pmod(F.unix_micros("ts"), F.lit(micros(period)))
    return F.when(fits, offset * F.lit(1 << seq_bits) + F.col("seq")).otherwise(
        F.raise_error(F.lit("seq does not fit seq_bits")).cast("long")
    )


def trade_bars(trades: DataFrame, period: float, seq_bits: int | None = None) -> DataFrame:
    """OHLC and volume per filled bin, in one aggregation that combines before the shuffle."""
    key = _order_key(period, seq_bits)
    return (
        trades.withColumn("_i", grid_index("ts", period))
        .groupBy("symbol", "_i")
        .agg(
            F.min_by("price", key).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", key).alias("close"),
            F.sum("size").alias("volume"),
        )
        .select("symbol", grid_time("_i", period).alias("bar_ts"), *PRICES, "volume")
    )


def bars_ohlc(trades: DataFrame, period: float, seq_bits: int | None = None) -> DataFrame:
    return trade_bars(trades, period, seq_bits).drop("volume")


def bars_mean(ticks: DataFrame, period: float, column: str = "d_vwap") -> DataFrame:
    """Mean of a tick column per bin."""
    return (
        ticks.groupBy("symbol", grid_index("ts", period).alias("_i"))
        .agg(F.avg(column).alias(column))
        .select("symbol", grid_time("_i", period).alias("bar_ts"), column)
    )


def _reach(sparse: DataFrame, period: float, rows: int) -> DataFrame:
    """Each filled bar with `_end`, the last grid position before the symbol's next filled bar.

    Inside a block that is a lead(); the last bar of a block takes the first position of the
    symbol's next filled block from the block summaries.
    """
    f = Frame.of(sparse, period, rows=rows)
    f = f.add(_next=F.lead("_i").over(f.w))
    later = Window.partitionBy("symbol").orderBy("_b")
    f = f.carry_with(
        {"_first": F.min("_i")},
        lambda part: part.select("symbol", "_b", F.lead("_first").over(later).alias("_next_block")),
    )
    end = F.coalesce(F.col("_next"), F.col("_next_block"), F.col("_i") + 1) - 1
    return f.add(_end=end).drop("_next", "_next_block", "_b").df


def _spread(reach: DataFrame, rows: int) -> DataFrame:
    """One row per grid position of a bar's reach: first split by block, so no array is long."""
    blocks = F.sequence(F.floor(F.col("_i") / rows), F.floor(F.col("_end") / rows))
    by_block = reach.withColumn("_b", F.explode(blocks))
    first = F.greatest(F.col("_i"), F.col("_b") * rows)
    last = F.least(F.col("_end"), F.col("_b") * rows + rows - 1)
    return by_block.withColumn("_p", F.explode(F.sequence(first, last)))


def fill_bars(sparse: DataFrame, period: float, rows: int = BLOCK_ROWS) -> DataFrame:
    """Gap-free bars: an empty bin repeats each column's last value and has volume 0.

    Every filled bar is stretched over the empty bins that follow it. That yields the grid and the
    forward fill together, with neither a join against a calendar nor a window over a whole symbol.
    """
    values = [c for c in sparse.columns if c not in ("symbol", "bar_ts", "volume")]
    out = _spread(_reach(sparse, period, rows), rows)
    volume = F.when(F.col("_p") == F.col("_i"), F.coalesce("volume", F.lit(0.0))).otherwise(F.lit(0.0))
    extra = [volume.alias("volume")] if "volume" in sparse.columns else []
    return out.select("symbol", grid_time("_p", period).alias("bar_ts"), *values, *extra)


def bars_grid(sparse: DataFrame, period: float, rows: int = BLOCK_ROWS) -> DataFrame:
    """The grid with empty bins left NULL (volume 0)."""
    values = [c for c in sparse.columns if c not in ("symbol", "bar_ts", "volume")]
    out = _spread(_reach(sparse, period, rows), rows)
    here = F.col("_p") == F.col("_i")
    cols = [F.when(here, F.col(c)).alias(c) for c in values]
    if "volume" in sparse.columns:
        cols.append(F.when(here, F.coalesce("volume", F.lit(0.0))).otherwise(F.lit(0.0)).alias("volume"))
    return out.select("symbol", grid_time("_p", period).alias("bar_ts"), *cols)


def bars_volume(trades: DataFrame, period: float, rows: int = BLOCK_ROWS) -> DataFrame:
    sparse = (
        trades.groupBy("symbol", grid_index("ts", period).alias("_i"))
        .agg(F.sum("size").alias("volume"))
        .select("symbol", grid_time("_i", period).alias("bar_ts"), "volume")
    )
    return bars_grid(sparse, period, rows)


def bars(trades: DataFrame, period: float, rows: int = BLOCK_ROWS, seq_bits: int | None = None) -> DataFrame:
    """Gap-free OHLCV bars, the input of every feature."""
    return fill_bars(trade_bars(trades, period, seq_bits), period, rows)


def newest_bars(trades: DataFrame, period: float, n: int, rows: int = BLOCK_ROWS, seq_bits: int | None = None) -> DataFrame:
    """The last n of the gap-free bars per symbol, without filling the gaps before them.

    The last n filled bars cover at least n bins. Those before the first bin wanted leave, and the
    one that reaches into it starts there, as an empty bin.
    """
    every = Window.partitionBy("symbol")  # n filled bars at most
    i = grid_index("bar_ts", period)
    sparse = last_bars(trade_bars(trades, period, seq_bits), n).withColumn("_at", i)
    sparse = sparse.select("*", (F.max("_at").over(every) - (n - 1)).alias("_first"), F.lead("_at").over(every.orderBy("_at")).alias("_then"))
    sparse = sparse.filter("_at >= _first or _then > _first")
    moved = {"bar_ts": grid_time(F.greatest("_at", "_first"), period), "volume": F.when(F.col("_at") >= F.col("_first"), F.col("volume")).otherwise(0.0)}
    return fill_bars(sparse.withColumns(moved).drop("_at", "_first", "_then"), period, rows)


def bars_merge(ohlc: DataFrame, *others: DataFrame) -> DataFrame:
    """Join per-bin tables on the bin, keeping the bins of the first."""
    out = ohlc
    for other in others:
        out = out.join(other, ["symbol", "bar_ts"], "left")
    return out


def bars_upsert(new: DataFrame, old: DataFrame) -> DataFrame:
    """All bins of both sides; a column missing on the new side keeps its old value."""
    values = [c for c in new.columns if c not in ("symbol", "bar_ts")]
    prior = old.select("symbol", "bar_ts", *[F.col(c).alias(f"_old_{c}") for c in values if c in old.columns])
    joined = new.join(prior, ["symbol", "bar_ts"], "full_outer")
    keep = [F.coalesce(c, f"_old_{c}").alias(c) if c in old.columns else F.col(c) for c in values]
    return joined.select("symbol", "bar_ts", *keep)


def align(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Feature rows that have a label."""
    return features.join(labels.select("symbol", "bar_ts"), ["symbol", "bar_ts"], "left_semi")


def last_bars(df: DataFrame, n: int = 2) -> DataFrame:
    """Last n bars per symbol. The rank limit is applied per task before the shuffle."""
    newest = Window.partitionBy("symbol").orderBy(F.col("bar_ts").desc())
    return df.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= n).drop("_r")


def _running_ratio(f: Frame, name: str, num: Column, den: Column) -> Frame:
    f = f.running_sum(_num=num, _den=den)
    return f.add(**{name: div("_num", "_den")}).drop("_num", "_den")


def vwap_trade(trades: DataFrame, parts: int | None = None) -> DataFrame:
    """Running volume-weighted price of every trade, in (ts, seq) order."""
    ticks = trades.select("symbol", "ts", "seq", "price", "size")
    f = Frame.ranged(ticks, ["symbol"], ["ts", "seq"], parts)
    return _running_ratio(f, "d_vwap", F.col("price") * F.col("size"), F.col("size")).own(
        "symbol", "ts", "seq", "price", "size", "d_vwap"
    )


def vwap_hl(df: DataFrame, period: float, rows: int = BLOCK_ROWS, name: str = "vwap") -> DataFrame:
    """Running volume-weighted mean of high and low."""
    mid = F.col("volume") * (F.col("high") + F.col("low")) / 2
    return _running_ratio(Frame.of(df, period, rows=rows), name, mid, F.col("volume")).own()


def vwap_bar_open(df: DataFrame, period: float, rows: int = BLOCK_ROWS, name: str = "d_vwap") -> DataFrame:
    """Running volume-weighted open."""
    num = F.col("volume") * F.col("open")
    return _running_ratio(Frame.of(df, period, rows=rows), name, num, F.col("volume")).own()


def vwap_current(df: DataFrame, column: str = "d_vwap") -> DataFrame:
    """Latest value per symbol."""
    return df.groupBy("symbol").agg(F.max_by(column, "bar_ts").alias(column), F.max("bar_ts").alias("bar_ts"))
