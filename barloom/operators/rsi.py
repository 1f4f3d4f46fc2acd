"""Relative strength index with Wilder smoothing, as a scan over blocks.

The smoothed gain obeys avg = (avg * (n - 1) + gain) / n, so with d = (n - 1) / n it is a weighted
sum of all past gains, gain / n times d^age; the first n gains enter together as one mean, which is
the same as giving all of them the age of the n-th. Inside a block the sum is a running sum of
gain * d^-j times d^j, with j the place in the block. Across blocks only the ratio of gain to loss
matters, and both decay alike: the state handed on is the weighted sum over the last few blocks
that moved at all. One block of decay is already a factor d^rows; blocks so far back that their
weight is below e^-40 cannot change a double and are left out.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.frames import BLOCK_ROWS, Frame


def rsi(
    df: DataFrame, period: float, columns: Sequence[str], n: int = 14, rows: int | None = None
) -> DataFrame:
    """Add rsi_<column>; NULL up to position n of each symbol, 100 where nothing was lost."""
    if n < 2:
        raise ValueError("n must be at least 2")
    rows = rows or min(BLOCK_ROWS, int(600 / -math.log((n - 1) / n)))
    return rsi_stage(Frame.of(df, period, before=1, rows=rows), columns, n).own()


def rsi_stage(f: Frame, columns: Sequence[str], n: int = 14) -> Frame:
    """Frame form. The frame must borrow a row, and d^-rows must stay a finite double."""
    rows, decay = f.rows, (n - 1) / n
    if (rows + n) * -math.log(decay) > 650:
        raise ValueError("blocks are too long for this n")
    parts = [(c, k) for c in columns for k in ("up", "dn")]
    name = lambda p, c, k: f"_{p}_{k}_{c}"
    sign = {"up": 1.0, "dn": -1.0}

    f = f.carry({"_t": F.min("_i")}, {"_first": lambda _, every: F.min("_t").over(every)}, keep=1)
    f = f.add(**{f"_d_{c}": F.col(c) - F.lag(c).over(f.w) for c in columns}).trim()
    pos, j = F.col("_i") - F.col("_first"), (F.col("_i") - F.col("_b") * rows).cast("double")
    f = f.add(
        _pos=pos,
        _grow=F.pow(F.lit(1 / decay), j + F.greatest(n - pos, F.lit(0))) / n,
        _fade=F.pow(F.lit(decay), j),
    )
    f = f.add(
        **{
            name("y", c, k): F.greatest(F.coalesce(F.col(f"_d_{c}") * sign[k], F.lit(0.0)), F.lit(0.0)) * F.col("_grow")
            for c, k in parts
        }
    )
    ends = {name("e", c, k): F.sum(name("y", c, k)) * F.lit(decay ** (rows - 1)) for c, k in parts}
    f = f.carry_with(ends, lambda part: _states(part, f, columns, decay))
    f = f.add(**{name("s", c, k): F.sum(name("y", c, k)).over(f.cum) * F.col("_fade") for c, k in parts})
    out = {}
    for c in columns:
        state, local = F.col(f"_state_{c}"), {k: F.col(name("s", c, k)) for k in ("up", "dn")}
        still = (local["up"] + local["dn"]) == 0
        both = {
            k: F.when(state.isNull(), local[k])
            .when(still, state[k])
            .otherwise(local[k] + state[k] * state["fade"] * F.col("_fade"))
            for k in ("up", "dn")
        }
        value = F.when(both["dn"] == 0, F.lit(100.0)).otherwise(
            100 - 100 / (1 + F.try_divide(both["up"], both["dn"]))
        )
        out[f"rsi_{c}"] = F.when(F.col("_pos") > n, value)
    f = f.add(**out)
    used = [name(p, c, k) for p in ("y", "s") for c, k in parts]
    return f.drop(
        "_first", "_pos", "_grow", "_fade", *used, *[f"_d_{c}" for c in columns], *[f"_state_{c}" for c in columns]
    )


def _states(part: DataFrame, f: Frame, columns: Sequence[str], decay: float) -> DataFrame:
    """Per block: the gain and loss state left by the blocks before it."""
    per_block = -f.rows * math.log(decay)
    reach = math.ceil(40 / per_block) + 1
    by_block = Window.partitionBy(*f.keys).orderBy("_b")
    earlier = by_block.rowsBetween(Window.unboundedPreceding, -1)
    recent: list[Column] = []
    for c in columns:
        up, dn = F.col(f"_e_up_{c}"), F.col(f"_e_dn_{c}")
        entry = F.when(up + dn > 0, F.struct(F.col("_b").alias("b"), up.alias("up"), dn.alias("dn")))
        recent.append(entry.alias(f"_entry_{c}"))
    out = part.select(*f.keys, "_b", *recent)
    for c in columns:
        # Number the moving blocks, so that a bounded range of that number covers the last `reach`.
        moved = F.count(f"_entry_{c}").over(by_block.rowsBetween(Window.unboundedPreceding, 0))
        out = out.withColumn(f"_m_{c}", moved)
        last = Window.partitionBy(*f.keys).orderBy(f"_m_{c}").rangeBetween(1 - reach, 0)
        out = out.withColumn(f"_recent_{c}", F.collect_list(f"_entry_{c}").over(last))
        newest = F.array_max(F.transform(F.col(f"_recent_{c}"), lambda e: e["b"]))
        total = lambda k, c=c, newest=newest: F.aggregate(
            F.col(f"_recent_{c}"),
            F.lit(0.0),
            lambda acc, e: acc + e[k] * F.pow(F.lit(decay), ((newest - e["b"]) * f.rows).cast("double")),
        )
        state = F.when(
            F.size(f"_recent_{c}") > 0,
            F.struct(newest.alias("b"), total("up").alias("up"), total("dn").alias("dn")),
        )
        out = out.withColumn(f"_now_{c}", state)
    last = {c: F.last(f"_now_{c}", ignorenulls=True).over(earlier) for c in columns}
    out = out.select(*f.keys, "_b", *[last[c].alias(f"_last_{c}") for c in columns])
    # How much the state has faded at the first row of the block.
    age = lambda c: ((F.col("_b") - F.col(f"_last_{c}.b") - 1) * f.rows + 1).cast("double")
    state = lambda c: F.col(f"_last_{c}").withField("fade", F.pow(F.lit(decay), age(c)))
    return out.select(*f.keys, "_b", *[state(c).alias(f"_state_{c}") for c in columns])
