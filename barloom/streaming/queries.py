"""Streaming forms: trades to bars, running prices, kept bars, RSI and exit signals.

Each function takes a streaming DataFrame and returns one; `run` drives a query to the end of the
data there is (availableNow) or keeps it going with a trigger interval.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.operators.bars import bars_upsert
from barloom.operators.decisions import take_profit
from barloom.session import materialize
from barloom.sources.trades import TRADES


def trade_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Trades as an unbounded input from a folder. A message bus with the same columns fits as well."""
    return spark.readStream.schema(TRADES).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_bars(trades: DataFrame, period: float, delay: str = "1 hour") -> DataFrame:
    """Filled bars, each emitted once, when the watermark has passed its end.

    Rows later than the watermark are dropped; rows out of order but in time are not, because open
    and close go by event time and sequence number.
    """
    key = F.struct("ts", "seq")
    return (
        trades.withWatermark("ts", delay)
        .groupBy("symbol", F.window("ts", f"{int(period * 1_000_000)} microseconds").alias("w"))
        .agg(
            F.min_by("price", key).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", key).alias("close"),
            F.sum("size").alias("volume"),
        )
        .select("symbol", F.col("w.start").alias("bar_ts"), "open", "high", "low", "close", "volume")
    )


def stream_vwap(trades: DataFrame) -> DataFrame:
    """Volume-weighted price of all trades so far: one row of state per symbol, in update mode."""
    sums = trades.groupBy("symbol").agg(
        F.sum(F.col("price") * F.col("size")).alias("turnover"), F.sum("size").alias("volume")
    )
    return sums.withColumn("vwap", F.try_divide("turnover", "volume"))


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink with one folder per micro-batch; a repeated batch overwrites its own."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def upsert_writer(spark: SparkSession, path: str, bars: DataFrame) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that upserts bars into a table with one folder per day.

    Only the days that a micro-batch touches are read and written again; a repeated batch changes
    nothing. `bars` gives the columns.
    """
    schema = T.StructType([*bars.schema.fields, T.StructField("day", T.DateType())])
    spark.createDataFrame([], schema).write.mode("append").partitionBy("day").parquet(path)

    def write(batch: DataFrame, batch_id: int) -> None:
        new = materialize(batch.withColumn("day", F.to_date("bar_ts")), "batch")
        kept = batch.sparkSession.read.schema(schema).parquet(path)
        old = kept.join(new.select("day").distinct(), "day", "left_semi")
        merged = bars_upsert(new.drop("day"), old.drop("day")).withColumn("day", F.to_date("bar_ts"))
        merged = materialize(merged, "merged")  # the folders are still being read
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)

    return write


def kept_bars(bars: DataFrame, path: str) -> DataFrame:
    """The table that `upsert_writer` keeps; `bars` gives the columns."""
    schema = T.StructType([*bars.schema.fields, T.StructField("day", T.DateType())])
    return bars.sparkSession.read.schema(schema).parquet(path).select(*bars.columns)


def newest_rows(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Last state per key of an update-mode query written by `batch_writer`."""
    log = spark.read.parquet(path)
    values = [c for c in log.columns if c not in (key, "batch")]
    return log.groupBy(key).agg(*[F.max_by(c, "batch").alias(c) for c in values])


RSI_OUT = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("bar_ts", T.TimestampType()),
        T.StructField("rsi", T.DoubleType()),
    ]
)
RSI_STATE = T.StructType(
    [
        T.StructField("rows", T.LongType()),
        T.StructField("last", T.DoubleType()),
        T.StructField("gain", T.DoubleType()),
        T.StructField("loss", T.DoubleType()),
        T.StructField("seen", T.LongType()),
    ]
)
CHUNK = 256  # decay over so many rows is still far from the least double


def smoothed(moves: np.ndarray, state: float, first: int, n: int) -> np.ndarray:
    """Wilder average after each move; the first `first` of them still belong to the opening mean."""
    head = state + np.cumsum(moves[:first]) / n
    out, state = [head], float(head[-1]) if first else state
    for lo in range(first, len(moves), CHUNK):
        part = moves[lo : lo + CHUNK]
        decay = ((n - 1) / n) ** np.arange(1, len(part) + 1)
        out.append((state + np.cumsum(part / n / decay)) * decay)
        state = float(out[-1][-1])
    return np.concatenate(out)


def stream_rsi(bars: DataFrame, column: str = "close", n: int = 14) -> DataFrame:
    """RSI carried over micro-batches in five numbers per symbol.

    Within a micro-batch bars may come in any order. A bar at or before the last one of an earlier
    micro-batch is late or repeated and is left out, since the values after it are already out. A
    missing value moves nothing.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows, last, gain, loss, seen = state.get if state.exists else (0, math.nan, 0.0, 0.0, np.iinfo(np.int64).min)
        frame = pd.concat(list(parts)).drop_duplicates("bar_ts").sort_values("bar_ts")
        at = frame["bar_ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
        frame, at = frame[at > seen], at[at > seen]
        if not len(frame):
            return
        value = frame[column].astype("float64").ffill().fillna(last).to_numpy()
        change = np.nan_to_num(np.diff(value, prepend=last))
        first = min(max(n + 1 - rows, 0), len(value))
        up, down = (smoothed(np.maximum(x, 0), s, first, n) for x, s in ((change, gain), (-change, loss)))
        with np.errstate(divide="ignore", invalid="ignore"):
            out = np.where(down == 0, 100.0, 100 - 100 / (1 + up / down))
        shown = pd.Series(out, dtype="float64").where(np.arange(rows, rows + len(out)) > n, None)
        state.update((rows + len(value), float(value[-1]), float(up[-1]), float(down[-1]), int(at[-1])))
        yield pd.DataFrame({"symbol": key[0], "bar_ts": frame["bar_ts"].to_numpy(), "rsi": shown})

    return (
        bars.select("symbol", "bar_ts", column)
        .groupBy("symbol")
        .applyInPandasWithState(step, RSI_OUT, RSI_STATE, "append", GroupStateTimeout.NoTimeout)
    )


def stream_exit_signals(positions: DataFrame, loss_limit: float | None = -5.0) -> DataFrame:
    """Positions to close, from a stream of position records; run with a trigger of 3 seconds."""
    return take_profit(positions, loss_limit)


def start(
    stream: DataFrame,
    checkpoint: str,
    path: str | None = None,
    each: Callable[[DataFrame, int], None] | None = None,
    mode: str = "append",
    every: str | None = None,
) -> StreamingQuery:
    """Start a query into Parquet files or a foreachBatch sink; `every` None reads what is there and stops."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.foreachBatch(each).start() if each else writer.format("parquet").start(path)


def run(stream: DataFrame, checkpoint: str, **sink) -> None:
    query = start(stream, checkpoint, **sink)
    query.awaitTermination()
