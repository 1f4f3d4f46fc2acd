"""Order-book source: nested messages to flat levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LEVEL = T.StructType(
    [
        T.StructField("price", T.StructType([T.StructField("amount", T.StringType())])),
        T.StructField("quantity", T.DoubleType()),
    ]
)
BOOK = T.StructType([T.StructField("asks", T.ArrayType(_LEVEL)), T.StructField("bids", T.ArrayType(_LEVEL))])


def flatten_book(messages: DataFrame) -> DataFrame:
    """(symbol, side, level, price, quantity) from JSON bodies; prices arrive as text.

    `first_level` is the level of a message's first entry, for books sent in pages.
    """
    body = F.from_json("body", BOOK)
    sides = F.array(
        F.struct(F.lit("ask").alias("side"), body["asks"].alias("levels")),
        F.struct(F.lit("bid").alias("side"), body["bids"].alias("levels")),
    )
    sided = messages.select("symbol", "first_level", F.explode(sides).alias("s"))
    levels = sided.select("symbol", "first_level", F.col("s.side").alias("side"), F.posexplode("s.levels").alias("p", "l"))
    return levels.select(
        "symbol",
        "side",
        (F.col("first_level") + F.col("p")).alias("level"),
        F.col("l.price.amount").cast("double").alias("price"),
        F.col("l.quantity").alias("quantity"),
    )
