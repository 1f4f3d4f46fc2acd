"""Market-data inputs derived from the star-schema tables (FIXTURES.md has the same in SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.operators.frames import Frame
from barloom.session import prepare

PAGE_LEVELS = 25  # levels per side in one order-book message


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with zone-less times turned into instants (UTC)."""
    df = prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    cast = {c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"}
    return df.withColumns(cast) if cast else df


def _k() -> F.Column:
    return F.get_json_object("props", "$.k").cast("double")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        "ts",
        F.col("event_id").alias("seq"),
        F.col("value").alias("price"),
        _k().alias("size"),
    )


def trades_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"),
        "ts",
        F.col("event_id").alias("seq"),
        F.col("value").alias("price"),
        _k().alias("size"),
    )


def _supplier_symbol() -> F.Column:
    return F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))


def trades_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        _supplier_symbol().alias("symbol"),
        F.col("l_shipdate").alias("ts"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("size"),
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        F.col("ts").alias("DateTime"),
        F.col("value").alias("Bid"),
        (F.col("value") * (1 + (_k() + 1) / 10000)).alias("Ask"),
        _k().alias("Volume"),
    )


def bar_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar per order day and supplier; many fail the validity checks (open is not their own)."""
    t = trades_daily(spark, sf_dir)
    return t.groupBy("symbol", F.col("ts").alias("snapshot_ts")).agg(
        (F.avg("price") * F.when(F.max("size") > 45, 2.0).otherwise(1.0)).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.avg("price").alias("close"),
        F.sum("size").alias("volume"),
    )


def book_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resting orders, not yet ranked. `rank` sorts the best price of either side first."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    side = F.when(F.col("l_linestatus") == "O", "ask").otherwise("bid")
    return table(spark, sf_dir, "lineitem").select(
        _supplier_symbol().alias("symbol"),
        side.alias("side"),
        price.alias("price"),
        F.col("l_quantity").alias("quantity"),
        F.when(side == "ask", price).otherwise(-price).alias("rank"),
        F.col("l_orderkey").alias("id1"),
        F.col("l_linenumber").alias("id2"),
        F.col("l_partkey").alias("id3"),
    )


BOOK_ORDER = ("rank", "quantity", "id1", "id2", "id3")


def book_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole flat book with its 0-based level per side."""
    f = Frame.ranged(book_quotes(spark, sf_dir), ["symbol", "side"], BOOK_ORDER)
    return f.positions(pos="level").own("symbol", "side", "level", "price", "quantity")


def book_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested JSON messages, each with one page of levels per side, so no message is long."""
    level = F.struct(
        "level", F.struct(F.col("price").cast("string").alias("amount")).alias("price"), "quantity"
    )
    pages = (
        book_levels(spark, sf_dir)
        .groupBy("symbol", F.floor(F.col("level") / PAGE_LEVELS).alias("page"))
        .agg(
            F.sort_array(F.collect_list(F.when(F.col("side") == "ask", level))).alias("asks"),
            F.sort_array(F.collect_list(F.when(F.col("side") == "bid", level))).alias("bids"),
        )
    )
    strip = lambda a: F.transform(a, lambda x: F.struct(x["price"].alias("price"), x["quantity"].alias("quantity")))
    return pages.select(
        "symbol",
        (F.col("page") * PAGE_LEVELS).alias("first_level"),
        F.to_json(F.struct(strip(F.col("asks")).alias("asks"), strip(F.col("bids")).alias("bids"))).alias("body"),
    )


def held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What `positions` says of quantities and entry prices; a symbol that has lines has both."""
    li = table(spark, sf_dir, "lineitem")
    signed = F.when(F.col("l_returnflag") == "A", F.col("l_quantity")).when(
        F.col("l_returnflag") == "R", -F.col("l_quantity")
    )
    return li.groupBy(_supplier_symbol().alias("symbol")).agg(
        F.coalesce(F.sum(signed), F.lit(0.0)).alias("qty"),
        (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("avg_entry_price"),
    )


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = Window.partitionBy("symbol").orderBy(F.col("ts").desc(), F.col("seq").desc())
    last_two = trades_daily(spark, sf_dir).withColumn("_r", F.row_number().over(newest)).filter("_r <= 2")
    prices = last_two.groupBy("symbol").agg(
        F.max(F.when(F.col("_r") == 1, F.col("price"))).alias("current_price"),
        F.max(F.when(F.col("_r") == 2, F.col("price"))).alias("prior_price"),
    )
    qty = F.col("qty")
    return held(spark, sf_dir).join(prices, "symbol").select(
        "symbol",
        "qty",
        F.when(qty < 0, "SHORT").otherwise("LONG").alias("side"),
        "avg_entry_price",
        "current_price",
        ((F.col("current_price") - F.col("avg_entry_price")) * qty).alias("unrealized_pl"),
        ((F.col("current_price") - F.col("prior_price")) * qty).alias("unrealized_intraday_pl"),
        qty.alias("qty_available"),
        "prior_price",
    )


def event_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions for the symbols of `trades`."""
    signed = F.when(F.col("user_id") % 2 == 0, F.col("value")).otherwise(-F.col("value"))
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("symbol"))
        .agg(F.round(F.sum(signed) / 100).alias("qty"))
    )


def symbol_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "supplier")
        .filter("s_nationkey < 5")
        .select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"), F.lit("index").alias("rule"))
    )


def symbol_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All supplier symbols and some that have neither book nor position."""
    s = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol")
    )
    n = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("symbol")
    )
    return s.unionByName(n)


def desk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes and predictions per symbol for the order operators."""
    move = F.abs(F.col("current_price") - F.col("prior_price")) / 100000
    up = F.col("current_price") > F.col("prior_price")
    return positions(spark, sf_dir).select(
        "symbol",
        F.col("current_price").alias("res"),
        (-move).alias("best_bid"),
        move.alias("best_ask"),
        (F.abs("qty") / 1000).alias("risk"),
        F.when(up, 1).otherwise(0).alias("pred_buy"),
        F.when(up, 0).otherwise(1).alias("pred_sell"),
    )


def open_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("symbol"),
        F.when(F.col("o_orderkey") % 2 == 0, "buy").otherwise("sell").alias("side"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("limit_price"),
        F.lit(1.0).alias("qty"),
    )


def cancel_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols whose orders are to be cancelled: the customers of one market segment."""
    return (
        table(spark, sf_dir, "customer")
        .filter("c_mktsegment = 'BUILDING'")
        .select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("symbol"))
    )


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        _supplier_symbol().alias("symbol"),
        (F.col("l_linenumber") / 100.0).alias("offset"),
        F.col("o_orderdate").alias("placed_ts"),
        F.when(F.col("l_shipdate") >= F.col("o_orderdate"), F.col("l_shipdate")).alias("filled_ts"),
    )
