"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.session import materialize


def hooked(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with `m`, the least of a and all its neighbours b.

    An id's edges are dealt by the other end, too, so that a hub's are shared by as many tasks as a
    shuffle has: each share has its minimum, the shares' minima are combined, and the result goes
    back to every share.
    """
    shares = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = edges.withColumn("share", F.pmod(F.xxhash64("b"), F.lit(shares)))
    low = dealt.groupBy("a", "share").agg(F.min("b").alias("m"))
    low = low.groupBy("a").agg(F.least(F.min("m"), F.first("a")).alias("m"), F.collect_list("share").alias("shares"))
    back = low.select("a", F.explode("shares").alias("share"), "m")
    return dealt.join(back, ["a", "share"]).drop("share")


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, component) for every id on an edge (a, b); component is the smallest id that links reach.

    Every round hooks each id's larger neighbours, then its smaller ones, to its smallest neighbour,
    until all edges point at roots. Rounds grow with the logarithm of the longest chain; if `rounds`
    do not suffice the call fails rather than return a partial result. Null ends and loops are no
    edges. Each round is a table in the shared folder.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    e = materialize(e.where("a is not null and b is not null and a <> b").distinct(), "edges")
    for _ in range(rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = hooked(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = hooked(large)
        small = low.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()
        new = materialize(small, "edges")
        # Settled when each id has one root and no root is itself hooked to another id.
        ends = new.selectExpr("a as id", "1 as hooks", "0 as root").union(new.selectExpr("b", "0", "1"))
        open_ = ends.groupBy("id").agg(F.sum("hooks").alias("hooks"), F.max("root").alias("root"))
        if open_.where("hooks > 1 or (hooks > 0 and root > 0)").isEmpty():
            roots = new.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
            return new.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
        e = new
    raise RuntimeError(f"components did not settle in {rounds} rounds")
