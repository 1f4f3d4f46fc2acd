"""Order-book pressure from the first levels of either side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FLOOR = 0.002  # an imbalance of the wrong sign becomes this


def book_depth(book: DataFrame, n: int = 10, order: Sequence[str] = ("level",)) -> DataFrame:
    """First n levels per side. Each task keeps n rows per side before the shuffle."""
    best = Window.partitionBy("symbol", "side").orderBy(*order)
    ranked = book.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= n)
    return ranked.select("symbol", "side", (F.col("_r") - 1).alias("level"), "price", "quantity")


def book_top(depth: DataFrame) -> DataFrame:
    """Best prices and their midpoint, from any table of levels."""
    first = lambda side: F.min_by(
        F.when(F.col("side") == side, F.col("price")), F.when(F.col("side") == side, F.col("level"))
    )
    best = depth.groupBy("symbol").agg(first("ask").alias("best_ask"), first("bid").alias("best_bid"))
    return best.withColumn("midpoint", (F.col("best_ask") + F.col("best_bid")) / 2)


def weighted_depth(depth: DataFrame) -> DataFrame:
    """Per side, quantity over distance from the midpoint, summed and times the number of levels."""
    per_level = depth.join(book_top(depth), "symbol").withColumn(
        "_w", F.try_divide(F.col("quantity"), F.abs(F.col("price") - F.col("midpoint")))
    )
    side = lambda s: F.col("side") == s
    total = lambda s: F.sum(F.when(side(s), F.col("_w"))) * F.count(F.when(side(s), 1))
    return per_level.groupBy("symbol").agg(
        F.first("midpoint").alias("midpoint"), total("ask").alias("ask_depth"), total("bid").alias("bid_depth")
    )


def book_alpha(weighted: DataFrame) -> DataFrame:
    """Relative imbalance of the sides; one that is not positive becomes the floor."""
    a, b = F.col("ask_depth"), F.col("bid_depth")
    tilt = F.try_divide(a - b, (a + b) / 2)
    return weighted.withColumns(
        {
            "alpha": F.abs(tilt),
            "ask_alpha": F.when(tilt <= 0, FLOOR).otherwise(tilt),
            "bid_alpha": F.when(-tilt <= 0, FLOOR).otherwise(-tilt),
        }
    )


def book_defaults(symbols: DataFrame, alphas: DataFrame) -> DataFrame:
    """One row per wanted symbol; fixed values where its book is missing or one-sided."""
    joined = symbols.join(alphas, "symbol", "left")
    usable = F.col("alpha").isNotNull()
    fixed = {"ask_alpha": 0.5, "bid_alpha": 0.5, "ask_depth": 10000.0, "bid_depth": 10000.0, "midpoint": 999.0}
    return joined.select(
        "symbol", *[F.when(usable, F.col(c)).otherwise(F.lit(v)).alias(c) for c, v in fixed.items()]
    )
