"""Trade, quote and bar-snapshot sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRADES = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("seq", T.LongType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("size", T.DoubleType()),
    ]
)

QUOTES = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("DateTime", T.TimestampType()),
        T.StructField("Bid", T.DoubleType()),
        T.StructField("Ask", T.DoubleType()),
        T.StructField("Volume", T.DoubleType()),
    ]
)


def keep_symbols(trades: DataFrame, symbols: Sequence[str] | None = None) -> DataFrame:
    """Trades of the wanted symbols. A plain column predicate, so it reaches the Parquet scan."""
    return trades.filter(F.col("symbol").isin(list(symbols))) if symbols else trades


def read_trades(spark: SparkSession, path: str, symbols: Sequence[str] | None = None) -> DataFrame:
    return keep_symbols(spark.read.schema(TRADES).parquet(path), symbols)


def read_quotes_csv(spark: SparkSession, path: str) -> DataFrame:
    """Quote ticks from CSV with a fixed schema; Volume is read as volume. A malformed line is an error."""
    return (
        spark.read.schema(QUOTES)
        .option("header", True)
        .option("mode", "FAILFAST")
        .option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
        .csv(path)
        .withColumnRenamed("DateTime", "ts")
        .withColumnRenamed("Volume", "volume")
    )


def quote_mid(quotes: DataFrame) -> DataFrame:
    """Mid price as close; bid and ask are not needed after this."""
    return quotes.withColumn("close", (F.col("Bid") + F.col("Ask")) / 2).drop("Bid", "Ask")


def latest_good_bars(snapshots: DataFrame) -> DataFrame:
    """Newest snapshot per symbol whose bar is valid; a bad newer one falls back to an older one.

    Only the first row per symbol survives, so Spark cuts each task's output to one row per symbol
    before the shuffle.
    """
    good = (
        F.col("open").isNotNull()
        & F.col("close").isNotNull()
        & (F.col("low") > 0)
        & (F.col("low") <= F.least("open", "close"))
        & (F.col("high") >= F.greatest("open", "close"))
        & (F.col("volume") > 0)
    )
    newest = Window.partitionBy("symbol").orderBy(F.col("snapshot_ts").desc())
    return snapshots.filter(good).withColumn("_r", F.row_number().over(newest)).filter("_r = 1").drop("_r")
