"""Exact order statistics without sorting the data or gathering a group.

The wanted rank is located in a histogram with logarithmic buckets, and then, as often as needed,
in one with equal-width buckets between the least and the greatest value of the bucket found, until
few enough values are left to be ranked one by one. Every step is a count that combines before the
shuffle. Whatever the data, no window sees more than FINE buckets or FEW values of a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import materialize

FINE = 4096  # equal-width buckets of a step
FEW = 4096  # values that are ranked one by one
PER_OCTAVE = 32  # logarithmic buckets per factor of two in the first step
SHIFT = 40_000  # keeps bucket numbers of the smallest doubles positive
SALTS = 16  # tasks that one group's values are dealt to


def _log_bucket(v: Column) -> Column:
    """Grows with v: the larger v, the larger (or equal) the bucket."""
    size = F.floor(F.log2(F.abs(v)) * PER_OCTAVE) + SHIFT
    return F.when(v == 0, F.lit(0)).otherwise(F.signum(v).cast("long") * size)


def _counted(rows: DataFrame, by: list[str], bucket: str) -> DataFrame:
    return rows.groupBy(*by, bucket).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )


def _locate(hist: DataFrame, wanted: DataFrame, by: list[str], bucket: str) -> DataFrame:
    """The bucket that holds each wanted rank (its count and range), and the rank inside it."""
    run = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("_before", F.coalesce(F.sum("_n").over(run), F.lit(0)))
    inside = (F.col("rank") > F.col("_before")) & (F.col("rank") <= F.col("_before") + F.col("_n"))
    found = wanted.join(hist, by).filter(inside)
    return found.withColumn("rank", F.col("rank") - F.col("_before")).drop("_before", bucket)


def order_statistics(
    df: DataFrame, keys: Sequence[str], value: str, wanted: DataFrame, few: bool = False
) -> DataFrame:
    """Value at each wanted 1-based rank.

    `wanted` has the keys, a `name` and a `rank`; the result has the keys, `name` and the value.
    `few` says that `wanted` is a handful of rows by construction, so it may be broadcast; else a
    group's values are dealt to several tasks, and its few bounds are copied to each.
    """
    keys = list(keys)
    by = [*keys, "name"]
    v = F.col(value)
    rows = df.filter(v.isNotNull()).select(*keys, v.alias("_v"))
    first = _counted(rows.withColumn("_b", _log_bucket(F.col("_v"))), keys, "_b")
    found = materialize(_locate(first, wanted.select(*by, "rank"), keys, "_b"), "ranks")
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_v", F.monotonically_increasing_id()), F.lit(SALTS)))

    def within(found: DataFrame) -> DataFrame:
        """Values in the range of each bound of their group."""
        near = (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
        if few:
            return rows.join(F.broadcast(found.drop("rank", "_n")), keys).filter(near)
        copies = found.drop("rank", "_n").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
        return rows.join(copies, [*keys, "_salt"]).filter(near)

    # A step splits the least from the greatest value at least, and narrows the range FINE times.
    while not found.filter((F.col("_n") > FEW) & (F.col("_lo") < F.col("_hi"))).isEmpty():
        # Scaled before subtracting, so that a range over all doubles does not overflow.
        share = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
        share = F.when(F.col("_v") == F.col("_hi"), F.lit(1.0)).otherwise(F.coalesce(share, F.lit(0.0)))
        bucket = F.least(F.floor(share * FINE), F.lit(FINE - 1))
        fine = _counted(within(found).withColumn("_b", bucket), by, "_b")
        found = materialize(_locate(fine, found.select(*by, "rank"), by, "_b"), "ranks")
    alike = found.filter("_lo = _hi").select(*by, F.col("_lo").alias(value))
    rest = found.filter("_lo < _hi")
    distinct = within(rest).groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    distinct = distinct.withColumn("_before", F.coalesce(F.sum("_n").over(run), F.lit(0)))
    at = rest.select(*by, "rank").join(distinct, by)
    at = at.filter((F.col("rank") > F.col("_before")) & (F.col("rank") <= F.col("_before") + F.col("_n")))
    return alike.union(at.select(*by, F.col("_v").alias(value)))


def quantile_ranks(counts: DataFrame, keys: Sequence[str], quantiles: Sequence[float]) -> DataFrame:
    """Ranks on both sides of each quantile position (n - 1) * q, and the weight of the upper one."""
    h = lambda q: (F.col("n") - 1) * F.lit(float(q))
    marks = F.array(*[F.struct(F.lit(q).alias("q"), h(q).alias("h")) for q in quantiles])
    at = counts.filter("n > 0").select(*keys, F.explode(marks).alias("m"))
    return at.select(
        *keys, F.col("m.q").alias("q"), (F.floor("m.h") + 1).alias("low"), (F.ceil("m.h") + 1).alias("high"),
        (F.col("m.h") - F.floor("m.h")).alias("weight"),
    )
