"""Labels, time-ordered splits and classification metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import div
from barloom.operators.frames import BLOCK_ROWS, Frame


def future_return(df: DataFrame, period: float, price: str = "close", rows: int = BLOCK_ROWS) -> DataFrame:
    """Return from this bar to the symbol's next one, which may be any number of bins away.

    The next bar of the last one in a block is the first of the next filled block, taken from the
    block summaries, so bars with gaps need no neighbouring rows.
    """
    f = Frame.of(df, period, rows=rows)
    f = f.add(_inside=F.lead(F.lit(True)).over(f.w), _lead=F.lead(price).over(f.w))
    later = Window.partitionBy("symbol").orderBy("_b")
    f = f.carry_with(
        {"_first": F.min_by(price, "_i")},
        lambda part: part.select("symbol", "_b", F.lead("_first").over(later).alias("_after")),
    )
    nxt = F.when(F.col("_inside"), F.col("_lead")).otherwise(F.col("_after"))
    out = f.add(_next=nxt).add(future_return=div("_next", price) - 1)
    return out.own().drop("_inside", "_lead", "_after")


def labels(df: DataFrame, period: float, price: str = "close", rows: int = BLOCK_ROWS) -> DataFrame:
    """label_buy is 1 if the next bar is higher, label_sell if it is lower, else 0.

    Bars whose return has no sign have no label: the last one, and those that stay at price 0.
    """
    now, nxt = F.col(price), F.col("_next")
    f = future_return(df, period, price, rows).filter(nxt.isNotNull() & ((now != 0) | (nxt != 0)))
    up = F.when(now == 0, F.signum(nxt)).otherwise(F.signum(F.try_divide(nxt, now) - 1))
    return f.withColumns(
        {"label_buy": F.when(up > 0, 1).otherwise(0), "label_sell": F.when(up < 0, 1).otherwise(0)}
    ).drop("_next")


def split_time(df: DataFrame, period: float, form: str = "batch", rows: int = BLOCK_ROWS) -> DataFrame:
    """Name of the time-ordered part each row belongs to, per symbol.

    live: 50 / 25 / 25 as train, valid, test. batch: the first half is cut 45 / 55 in train and
    test, one row is left out, the rest is cut 65 / 35 in valid and valid2. The later part of a cut
    is rounded up.
    """
    f = Frame.of(df, period, rows=rows).positions()
    pos, n = F.col("pos"), F.col("n")
    if form == "live":
        train = n - F.ceil(n * 0.5)
        rest = n - train
        valid = rest - F.ceil(rest * 0.5)
        part = F.when(pos < train, "train").when(pos < train + valid, "valid").otherwise("test")
    else:
        half = F.bround(n / 2).cast("long")  # round half to even, as Python does
        train = half - F.ceil(half * 0.55)
        rest = F.greatest(n - half - 1, F.lit(0))
        valid = rest - F.ceil(rest * 0.35)
        part = (
            F.when(pos < train, "train")
            .when(pos < half, "test")
            .when(pos == half, "gap")
            .when(pos <= half + valid, "valid")
            .otherwise("valid2")
        )
    return f.add(split=part).own()


def forward_folds(
    df: DataFrame, period: float, folds: int = 3, gap: int = 1, rows: int = BLOCK_ROWS
) -> DataFrame:
    """Forward-chaining folds: fold k tests block k of `folds` and trains on all before its gap.

    Only a row's own number of folds is emitted: it is tested once at most and trains in the folds
    that come later.
    """
    f = Frame.of(df, period, rows=rows).positions()
    pos, n = F.col("pos"), F.col("n")
    size = F.floor(n / (folds + 1))
    start = lambda k: n - size * (folds - k)
    role = lambda k: (
        F.when((pos >= start(k)) & (pos < start(k) + size), "test").when(pos < start(k) - gap, "train")
    )
    roles = F.filter(
        F.array(*[F.struct(F.lit(k).alias("fold"), role(k).alias("role")) for k in range(folds)]),
        lambda r: r["role"].isNotNull(),
    )
    f = f.add(_r=F.explode(roles))
    return f.add(fold=F.col("_r.fold"), role=F.col("_r.role")).drop("_r").own()


def naive_predictions(df: DataFrame, period: float, rows: int = BLOCK_ROWS) -> DataFrame:
    """y: will the next bar be higher; pred: was this bar higher than the last one."""
    f = Frame.of(df, period, before=1, after=1, rows=rows)
    close = F.col("close")
    f = f.add(
        _next=F.lead(close).over(f.w),
        y=F.when(F.signum(div(F.lead(close).over(f.w), close) - 1) > 0, 1).otherwise(0),
        pred=F.when(F.signum(div(close, F.lag(close).over(f.w)) - 1) > 0, 1).otherwise(0),
    )
    return f.own("symbol", "bar_ts", "y", "pred", "_next").filter("_next is not null").drop("_next")


def _count(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def _f1(hit: Column, wrong: Column) -> Column:
    return F.coalesce(F.try_divide(2 * hit, 2 * hit + wrong), F.lit(0.0))


def metrics(predictions: DataFrame, *by: str) -> DataFrame:
    """Accuracy and macro F1 in one aggregation. A class that never occurs is not averaged in."""
    y, p = F.col("y"), F.col("pred")
    counts = predictions.groupBy(*by).agg(
        _count((y == 1) & (p == 1)).alias("tp"),
        _count((y == 0) & (p == 0)).alias("tn"),
        _count((y == 0) & (p == 1)).alias("fp"),
        _count((y == 1) & (p == 0)).alias("fn"),
    )
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    seen = [F.when(tp + fn + fp > 0, 1).otherwise(0), F.when(tn + fn + fp > 0, 1).otherwise(0)]
    macro = F.try_divide(_f1(tp, fp + fn) + _f1(tn, fp + fn), seen[0] + seen[1])
    return counts.select(
        *by, F.try_divide(tp + tn, tp + tn + fp + fn).alias("accuracy"), macro.alias("f1_macro")
    )


def confusion(predictions: DataFrame, *by: str) -> DataFrame:
    """Rows: true class; columns: how often 0 and 1 were predicted."""
    counts = predictions.groupBy(*by, "y").pivot("pred", [0, 1]).count()
    return counts.select(
        *by,
        "y",
        F.coalesce(F.col("0"), F.lit(0)).alias("pred_0"),
        F.coalesce(F.col("1"), F.lit(0)).alias("pred_1"),
    )
