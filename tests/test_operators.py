"""Hand-made cases for bars, labels, book, quotes, decisions and streams."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import bars as B
from barloom.operators import book as K
from barloom.operators import decisions as D
from barloom.operators import labels as L
from barloom.operators import model as M
from barloom.operators import quotes as Q
from barloom.operators.orderstats import order_statistics
from barloom.session import new_path
from barloom.streaming import queries as S

MINUTES5 = 300


def ticks(spark, rows):
    pdf = pd.DataFrame(rows, columns=["symbol", "ts", "seq", "price", "size"])
    return spark.createDataFrame(pdf.assign(ts=pd.to_datetime(pdf.ts)))


TICKS = [
    ("A", "2024-01-01 10:00:01", 2, 11.0, 1.0),
    ("A", "2024-01-01 10:00:01", 1, 10.0, 1.0),  # same instant, earlier number
    ("A", "2024-01-01 10:04:59", 3, 9.0, 0.0),
    ("A", "2024-01-01 10:21:00", 4, 20.0, 5.0),
    ("B", "2024-01-01 10:02:00", 5, 7.0, 2.0),
]


@pytest.mark.parametrize("bits", [None, 20])
def test_bars_fill_gaps_and_break_ties(spark, bits):
    got = B.bars(ticks(spark, TICKS), MINUTES5, rows=2, seq_bits=bits).toPandas().sort_values(["symbol", "bar_ts"])
    a = got[got.symbol == "A"]
    assert len(a) == 5 and len(got) == 6
    assert list(a.open) == [10, 10, 10, 10, 20] and list(a.close) == [9, 9, 9, 9, 20]
    assert list(a.high) == [11, 11, 11, 11, 20] and list(a.volume) == [2, 0, 0, 0, 5]


def test_bar_properties(spark):
    df = spark.range(2000).select(
        F.concat(F.lit("S"), (F.col("id") % 3).cast("string")).alias("symbol"),
        F.timestamp_seconds(F.col("id") * 97 % 100000).alias("ts"), F.col("id").alias("seq"),
        (F.col("id") % 89 + 1).cast("double").alias("price"), (F.col("id") % 5).cast("double").alias("size"),
    )
    got = B.bars(df, MINUTES5, rows=16).toPandas()
    assert got.volume.sum() == df.agg(F.sum("size")).first()[0]
    assert (got.low <= got[["open", "close"]].min(axis=1)).all() and (got.high >= got[["open", "close"]].max(axis=1)).all()
    assert not got.duplicated(["symbol", "bar_ts"]).any()


def test_upsert_keeps_old_only_bars(spark):
    ts = pd.to_datetime(["2024-01-01 00:00", "2024-01-01 01:00", "2024-01-01 02:00"])
    old = spark.createDataFrame(pd.DataFrame({"symbol": "A", "bar_ts": ts[:2], "close": [1.0, 2.0]}))
    new = spark.createDataFrame(pd.DataFrame({"symbol": "A", "bar_ts": ts[1:], "close": [9.0, 3.0]}))
    got = B.bars_upsert(new, old).toPandas().sort_values("bar_ts")
    assert list(got.close) == [1.0, 9.0, 3.0]


def grid(spark, n):
    ts = pd.date_range("2024-01-01", periods=n, freq="h")
    return spark.createDataFrame(pd.DataFrame({"symbol": "A", "bar_ts": ts, "close": [float(i % 7) for i in range(n)]}))


@pytest.mark.parametrize("n", [101, 20])
def test_splits_and_folds(spark, n):
    df = grid(spark, n)
    s = L.split_time(df, 3600, rows=8).toPandas().sort_values("bar_ts")
    order = ["train", "test", "gap", "valid", "valid2"]
    assert len(s) == n and list(s.split) == sorted(s.split, key=order.index) and (s.split == "gap").sum() == 1
    live = L.split_time(df, 3600, form="live", rows=8).toPandas().split.value_counts()
    assert live.sum() == n and live["train"] == n // 2
    folds = L.forward_folds(df, 3600, folds=3, gap=1, rows=8).toPandas()
    for _, g in folds.groupby("fold"):
        train, test = g[g.role == "train"].pos, g[g.role == "test"].pos
        assert train.max() == test.min() - 2 and len(test) == n // 4


def test_labels_drop_the_last_bar(spark):
    got = L.labels(grid(spark, 15), 3600, rows=4).toPandas().sort_values("bar_ts")
    assert len(got) == 14 and list(got.label_buy[:7]) == [1, 1, 1, 1, 1, 1, 0] and got.label_sell.iloc[6] == 1


def test_metrics(spark):
    pairs = [(1, 1)] * 3 + [(1, 0)] * 1 + [(0, 1)] * 2 + [(0, 0)] * 4
    df = spark.createDataFrame(pairs, "y int, pred int")
    acc, f1 = L.metrics(df).first()
    assert acc == pytest.approx(0.7) and f1 == pytest.approx((6 / 9 + 8 / 11) / 2)


def test_book_crossed_one_sided_missing(spark):
    rows = [
        ("X", "ask", 0, 9.0, 2.0), ("X", "ask", 1, 12.0, 1.0), ("X", "bid", 0, 10.0, 4.0),
        ("ONE", "ask", 0, 5.0, 1.0),
    ]
    book = spark.createDataFrame(rows, "symbol string, side string, level int, price double, quantity double")
    alphas = K.book_alpha(K.weighted_depth(K.book_depth(book)))
    x = alphas.filter("symbol = 'X'").first()
    assert x.midpoint == 9.5 and x.ask_depth == pytest.approx((4 + 0.4) * 2) and x.bid_depth == 8.0
    assert x.bid_alpha == 0.002 and x.ask_alpha == pytest.approx(0.8 / 8.4)
    wanted = spark.createDataFrame([("X",), ("ONE",), ("NONE",)], "symbol string")
    got = {r.symbol: r for r in K.book_defaults(wanted, alphas).collect()}
    assert got["ONE"].ask_alpha == got["NONE"].ask_alpha == 0.5 and got["NONE"].midpoint == 999.0


def test_quote_overflow_and_bad_base_are_null(spark):
    rows = [(0.01, 1e-9, 1.0), (1e-9, 5.0, 1.0), (0.5, -0.2, 1.0), (0.0, 1.0, 1.0), (0.01, 1.5, 1.0)]
    df = spark.createDataFrame(rows, "gamma double, k double, inventory double").withColumns(
        {c: F.lit(v) for c, v in {"sigma": 2.0, "mu": 1.0, "bid_alpha": 0.5, "ask_alpha": 0.5}.items()}
    )
    got = Q.spread_sym(df).toPandas().bid_spread_aysm
    assert got.isna().tolist()[2:4] == [True, True] and got.iloc[4] > 0
    assert not (got.abs() == float("inf")).any()


def test_gamma_rules(spark):
    sym = spark.createDataFrame([("P",), ("I",), ("NONE",)], "symbol string")
    pos = spark.createDataFrame([("P", -300.0), ("I", 20.0)], "symbol string, qty double")
    rules = spark.createDataFrame([("I", "index")], "symbol string, rule string")
    got = {r.symbol: r.gamma for r in Q.gamma(sym, pos, rules).collect()}
    assert got == {"P": pytest.approx(0.3), "I": pytest.approx(0.2), "NONE": pytest.approx(0.007)}


def test_minutes_left_rounds_half_to_even(spark):
    df = spark.sql("select timestamp '2024-01-30 21:57:30' as t union all select timestamp '2024-01-30 21:58:30'")
    assert sorted(r[0] for r in df.select(Q.minutes_left(F.col("t"))).collect()) == [2.0, 2.0]


def test_exit_orders_for_short_and_long(spark):
    pos = spark.createDataFrame([("S", "SHORT", -10.0), ("L", "LONG", 10.0)], "symbol string, side string, qty_available double")
    desk = spark.createDataFrame([("S", 100.0, -0.004, 0.02), ("L", 100.0, -0.02, 0.02)], "symbol string, res double, best_bid double, best_ask double")
    rungs = D.match_ladder(pos, desk).toPandas().sort_values(["symbol", "step"])
    s = rungs[rungs.symbol == "S"]
    assert (s.order_side == "BUY").all() and list(s.qty) == list(range(1, 11))
    assert s.limit_price.iloc[0] == pytest.approx(98.95) and s.stop_loss.iloc[-1] == pytest.approx(109.95)
    one = {r.symbol: r for r in D.match_single(pos, desk).collect()}
    assert one["L"].order_side == "SELL" and one["L"].stop_loss == pytest.approx(98.0) and one["L"].take_profit == pytest.approx(100.06)


def test_exit_of_a_negative_reservation_price(spark):
    pos = spark.createDataFrame([("L", "LONG", 10.0)], "symbol string, side string, qty_available double")
    desk = spark.createDataFrame([("L", -100.0, -0.1, 0.2)], "symbol string, res double, best_bid double, best_ask double")
    r = D.match_single(pos, desk).first()
    assert (r.take_profit, r.stop_loss, r.limit_price) == (99.4, 120.0, 100.2)


def test_cancels_take_every_order_in_requests(spark):
    orders = spark.range(1201).select(
        F.col("id").alias("order_id"), F.lit("A").alias("symbol"), F.lit("buy").alias("side"), F.lit("O").alias("status")
    )
    gone = D.cancels(orders.repartition(7), spark.createDataFrame([("A",), ("A",)], "symbol string"))
    assert D.remaining(orders, gone).count() == 0 and gone.count() == 1201
    per = {r.request: (r.lo, r.hi) for r in gone.groupBy("request").agg(F.min("order_id").alias("lo"), F.max("order_id").alias("hi")).collect()}
    assert per == {1: (701, 1200), 2: (201, 700), 3: (0, 200)}


def test_labels_of_sparse_bars_over_block_borders(spark):
    at = [0, 3, 17, 18, 95]
    df = spark.createDataFrame([("A", k * 3600, 10.0 + k) for k in at], "symbol string, s long, close double")
    bars = df.select("symbol", F.timestamp_seconds("s").alias("bar_ts"), "close")
    got = L.labels(bars, 3600, rows=4).orderBy("bar_ts").collect()
    assert [r.label_buy for r in got] == [1, 1, 1, 1]
    assert [r.future_return for r in got] == pytest.approx([(10 + b) / (10 + a) - 1 for a, b in zip(at, at[1:])])


def test_decay_fit_weighs_every_order(spark):
    rows = [("A", x / 100, 20 * math.exp(-30 * x / 100) + 3) for x in range(1, 8)]
    rows += [("B", 0.01, 0.0)] * 1000 + [("B", 0.02, 5.0), ("B", 0.03, 0.0)]
    d = spark.createDataFrame(rows, "symbol string, offset double, duration double")
    fit = {r.symbol: r for r in Q.decay_fit(d, offset=True).collect()}
    assert (fit["A"].kappa, fit["A"].a, fit["A"].c) == (pytest.approx(30, rel=0.01), pytest.approx(20, rel=0.01), pytest.approx(3, rel=0.01))
    # 1,000 fills against 1: the curve passes near 0 at the first distance.
    assert abs(fit["B"].a * math.exp(-fit["B"].kappa * 0.01) + fit["B"].c) < 0.02


def test_cancel_requests_and_remaining(spark):
    orders = spark.range(30).select(
        F.col("id").alias("order_id"), F.lit("A").alias("symbol"), F.lit("buy").alias("side"),
        F.when(F.col("id") < 3, "F").otherwise("O").alias("status"),
    )
    sym = spark.createDataFrame([("A",)], "symbol string")
    gone = D.cancels(orders, sym, per_request=10)
    assert sorted(r.order_id for r in gone.filter("request = 1").collect()) == list(range(20, 30))
    assert D.remaining(orders, gone).count() == 0 and D.cancels(orders, sym, side="sell").count() == 0


def test_order_statistics_of_values_close_together(spark):
    """400,000 values near 1 and an outlier: steps go on until no group of values is large."""
    n = 400_000
    df = spark.range(n).select(F.lit("A").alias("k"), (1 + F.col("id") * 1e-12).alias("v"))
    df = df.union(spark.createDataFrame([("A", 1e9), ("A", -5.0), ("B", 2.0), ("B", 2.0), ("B", None)], "k string, v double"))
    wanted = spark.createDataFrame([("A", "lo", 2), ("A", "mid", 200_001), ("A", "hi", n + 2), ("B", "x", 2)], "k string, name string, rank long")
    for few in (True, False):
        got = {(r.k, r.name): r.v for r in order_statistics(df, ["k"], "v", wanted, few=few).collect()}
        assert got == {("A", "lo"): 1.0, ("A", "mid"): 1 + 199_999 * 1e-12, ("A", "hi"): 1e9, ("B", "x"): 2.0}


def test_model_beats_constant_and_repeats(spark):
    df = spark.range(400).select(
        F.lit("A").alias("symbol"), F.timestamp_seconds(F.col("id") * 3600).alias("bar_ts"),
        ((F.col("id") * 37) % 101).cast("double").alias("x"), ((F.col("id") * 17) % 13).cast("double").alias("noise"),
    ).withColumn("label", (F.col("x") > 50).cast("int"))
    kept, model = M.select_features(df, ["x", "noise"], "label", keep=1, steps=1, iterations=3)
    assert kept == ["x"]
    scored = M.predict(model, df)
    assert scored.filter("label = pred").count() > 390
    again = M.predict(M.train(df, ["x"], "label", 3), df)
    assert again.join(scored.select("bar_ts", F.col("pred").alias("p2")), "bar_ts").filter("pred <> p2").count() == 0


def test_repeated_micro_batch_changes_nothing(spark):
    path = new_path(spark, "kept-bars")
    ts = pd.to_datetime(["2024-01-01 00:00", "2024-01-02 01:00"])
    first = spark.createDataFrame(pd.DataFrame({"symbol": "A", "bar_ts": ts, "close": [1.0, 2.0]}))
    write = S.upsert_writer(spark, path, first)
    write(first, 0)
    second = spark.createDataFrame(pd.DataFrame({"symbol": ["A", "B"], "bar_ts": ts[1:].repeat(2), "close": [5.0, 7.0]}))
    write(second, 1)
    write(second, 1)
    assert sorted(r.close for r in S.kept_bars(first, path).collect()) == [1.0, 5.0, 7.0]


def test_streamed_rsi_with_late_and_repeated_bars(spark):
    from barloom.operators.rsi import rsi

    rng = np.random.default_rng(2)
    n = 700
    pdf = pd.DataFrame({"symbol": "A", "bar_ts": pd.date_range("2024-01-01", periods=n, freq="h"), "close": 100 + rng.normal(size=n).cumsum()})
    bars = spark.createDataFrame(pdf)
    path = new_path(spark, "rsi-in")
    # Shuffled inside a batch; the second batch repeats the end of the first and has one late bar.
    for lo, hi, extra in ((0, 400, []), (380, 700, [17])):
        part = pd.concat([pdf.iloc[lo:hi], pdf.iloc[extra]]).sample(frac=1, random_state=1)
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = new_path(spark, "rsi-out")
    S.run(S.stream_rsi(stream), new_path(spark, "rsi-state"), path=out)
    got = spark.read.parquet(out).orderBy("bar_ts").toPandas()
    want = rsi(bars, 3600, ["close"]).orderBy("bar_ts").toPandas()
    assert len(got) == n and np.allclose(got["rsi"], want["rsi_close"], equal_nan=True)


def test_newest_bars_equal_the_last_of_all_bars(spark):
    """Gaps before, at and after the first bin wanted; a symbol with fewer bars; a lone trade long before."""
    import numpy as np

    from barloom.operators.bars import bars, last_bars, newest_bars

    r, rows = np.random.default_rng(5), [("LONE", 0, 1, 9.0, 2.0), ("LONE", 4_000, 2, 8.0, 1.0), ("ONE", 3, 1, 4.0, 1.0)]
    for s, share in (("DENSE", 0.9), ("HALF", 0.5), ("THIN", 0.1)):
        rows += [(s, int(b), 10 * int(b) + k, float(r.uniform(1, 9)), float(r.integers(0, 5))) for b in np.flatnonzero(r.random(300) < share) for k in range(2)]
    trades = spark.createDataFrame(rows, "symbol string, b long, seq long, price double, size double")
    trades = trades.selectExpr("symbol", "timestamp_seconds(1704067200 + b * 86400 + seq % 7) as ts", "seq", "price", "size")
    for n in (1, 2, 9, 40):
        want = sorted(map(tuple, last_bars(bars(trades, 86400, rows=16), n).collect()))
        assert sorted(map(tuple, newest_bars(trades, 86400, n, rows=16).select("symbol", "bar_ts", "open", "high", "low", "close", "volume").collect())) == want
