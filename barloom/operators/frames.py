"""Ordered work on one series without giving the series to one task.

A symbol may hold a third of all rows, so no operator here opens a window over a whole symbol.
Bars lie on a dense time grid, which makes a bar's position arithmetic: the grid is cut into
blocks of `rows` bars and every window is partitioned by (symbol, block). A block therefore never
holds more than `rows` + halo bars, whoever the symbol is.

- Bounded look-back or look-ahead: each block also receives a copy of the neighbouring rows it
  needs (its halo), so a rolling window over the block equals one over the series.
- Unbounded look-back (running sums, last known value, whole-series totals): each block is reduced
  to one summary row, the few summaries are scanned per symbol, and the state before the block
  comes back by a join on (symbol, block), which is already how the rows are partitioned.

Ticks have no grid. They are range-partitioned on their full order instead, which splits even a
single instant, and the range is the block.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.functions.numeric import div, ln
from barloom.functions.rolling import Rolling, lag_name
from barloom.session import materialize

RANGE_ROWS = 1_000_000  # rows of a range of ticks at most, about
BLOCK_ROWS = 2048  # with its halo still below the 4096 rows a window keeps in plain memory

Scan = Callable[[WindowSpec, WindowSpec], Column]


def micros(seconds: float) -> int:
    return int(round(seconds * 1_000_000))


def grid_index(ts: Column | str, period: float) -> Column:
    """Number of the bar that holds `ts`, counted from 1970 (floor, also before it)."""
    us = F.unix_micros(ts)
    step = F.lit(micros(period))
    return ((us - F.pmod(us, step)) / step).cast("long")


def grid_time(index: Column | str, period: float) -> Column:
    index = F.col(index) if isinstance(index, str) else index
    return F.timestamp_micros(index * F.lit(micros(period)))


def _block(index: Column, rows: int) -> Column:
    return F.floor(index / F.lit(rows)).cast("long")


@dataclass(frozen=True)
class Frame:
    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    rows: int | None = None  # None: ranged blocks, which have no halo
    before: int = 0

    @classmethod
    def of(
        cls,
        df: DataFrame,
        period: float,
        before: int = 0,
        after: int = 0,
        keys: Sequence[str] = ("symbol",),
        rows: int = BLOCK_ROWS,
        gaps: bool = False,
    ) -> Frame:
        """Cut gap-free bars into blocks; `before` and `after` are the rows each block borrows.

        With `gaps`, bars may be missing: they are numbered first, at the price of a pass over block
        counts, and the neighbours borrowed are rows that exist, however far away.
        """
        i = F.col("_i")
        df = df.withColumn("_i", grid_index("bar_ts", period))
        if gaps:
            numbered = cls(df.withColumn("_b", _block(i, rows)), tuple(keys), ("_i",), rows).positions(pos="_at", n="_n").df
            df = numbered.drop("_b", "_n", "_i").withColumnRenamed("_at", "_i")
        if before or after:
            blocks = F.sequence(_block(i - after, rows), _block(i + before, rows))
            df = df.withColumn("_b", F.explode(blocks))
        else:
            df = df.withColumn("_b", _block(i, rows))
        return cls(df, tuple(keys), ("_i",), rows, before)

    @classmethod
    def ranged(cls, df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int | None = None) -> Frame:
        """Cut any ordered rows into ranges of about equal size, one per partition.

        Written out once, because the range bounds come from a sample: a second evaluation of the
        same plan could draw others, and the summaries have to fit the rows.
        """
        spark = df.sparkSession
        if parts is None:
            parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANGE_ROWS))
        ranged = df.repartitionByRange(parts, *keys, *order).withColumn("_b", F.spark_partition_id().cast("long"))
        return cls(materialize(ranged, "ranges"), tuple(keys), tuple(order))

    @property
    def w(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, "_b").orderBy(*self.order)

    @property
    def cum(self) -> WindowSpec:
        return self.w.rowsBetween(Window.unboundedPreceding, 0)

    def add(self, **columns: Column) -> Frame:
        """One stage: columns that only use columns of earlier stages."""
        return replace(self, df=self.df.select("*", *[c.alias(n) for n, c in columns.items()]))

    def put(self, **columns: Column) -> Frame:
        """Like add, but replaces columns of the same name."""
        return replace(self, df=self.df.withColumns(columns))

    def logs(self, *columns: str) -> Frame:
        """Adds _ln_<column>, unless it is there."""
        return self.add(**{f"_ln_{c}": ln(c) for c in columns if f"_ln_{c}" not in self.df.columns})

    def roll(self, **stats: Rolling) -> Frame:
        """Rolling statistics of columns that exist already; one set of lags per column."""
        longest: dict[str, int] = {}
        for s in stats.values():
            longest[s.x] = max(longest.get(s.x, 0), s.n)
        lags = {lag_name(x, k): F.lag(x, k).over(self.w) for x, n in longest.items() for k in range(1, n)}
        centers = {s.center: s.center_value() for s in stats.values() if s.kind.startswith("std")}
        f = self.add(**lags).add(**centers) if centers else self.add(**lags)
        return f.add(**{name: s.value() for name, s in stats.items()}).drop(*lags, *centers)

    def drop(self, *names: str) -> Frame:
        return replace(self, df=self.df.drop(*names))

    def store(self, label: str = "frame") -> Frame:
        """Write the frame out, so that the next carry does not compute its stages twice."""
        return replace(self, df=materialize(self.df, label))

    def trim(self) -> Frame:
        """Drop the borrowed rows once nothing looks back any more."""
        lo = F.col("_b") * self.rows
        inside = (F.col("_i") >= lo) & (F.col("_i") < lo + self.rows)
        return replace(self, df=self.df.filter(inside), before=0)

    def own(self, *select: str | Column) -> DataFrame:
        """Rows of the blocks themselves, without the borrowed ones."""
        df = self.df if self.rows is None else self.trim().df
        return df.select(*select) if select else df.drop("_i", "_b")

    def carry(self, totals: Mapping[str, Column], scans: Mapping[str, Scan], keep: int = 0) -> Frame:
        """Add, to every row, state gathered from the other blocks of its series.

        `totals` are aggregates per block; each scan turns them into a column, given a window over
        the earlier blocks and one over all blocks of the series. `keep` leading borrowed rows stay
        in the frame; the state is then the one before the first row that stays.
        """
        return self.carry_with(
            totals,
            lambda part: part.select(
                *self.keys,
                "_b",
                *[
                    scan(self._earlier(), Window.partitionBy(*self.keys)).alias(name)
                    for name, scan in scans.items()
                ],
            ),
            keep,
        )

    def carry_with(
        self, totals: Mapping[str, Column], scan: Callable[[DataFrame], DataFrame], keep: int = 0
    ) -> Frame:
        kept, inside = self.df, self.df
        if self.rows is not None:
            if keep > self.before:
                raise ValueError("cannot keep more rows than the blocks borrow")
            lo = F.col("_b") * self.rows - keep
            kept = self.df.filter(F.col("_i") >= lo)
            inside = kept.filter(F.col("_i") < lo + self.rows)
        part = inside.groupBy(*self.keys, "_b").agg(*[c.alias(n) for n, c in totals.items()])
        state = scan(part)
        return replace(self, df=kept.join(state, [*self.keys, "_b"], "left"), before=keep)

    def _earlier(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)

    # -- running operators built on carry --------------------------------------------------

    def running_sum(self, keep: int = 0, **sums: Column) -> Frame:
        """Running totals over the whole series. NULLs count nothing and stay NULL, as in pandas."""
        return self.running(sums=sums, keep=keep)

    def pct_change(self, keep: int = 0, **changes: Column) -> Frame:
        """x / previous x - 1 after filling gaps with the last known x (in both places)."""
        return self.running(changes=changes, keep=keep)

    def running(
        self,
        sums: Mapping[str, Column] | None = None,
        changes: Mapping[str, Column] | None = None,
        keep: int = 0,
    ) -> Frame:
        """Running sums and gap-filled relative changes in one pass over the block summaries."""
        sums, changes = sums or {}, changes or {}
        seq = self.order[0] if len(self.order) == 1 else None
        position = F.col(seq) if seq else F.struct(*self.order)
        f = self.add(**{f"_x_{n}": c for n, c in {**sums, **changes}.items()})
        totals: dict[str, Column] = {}
        scans: dict[str, Scan] = {}
        for n in sums:
            totals[f"_t_{n}"] = F.sum(f"_x_{n}")
            scans[f"_c_{n}"] = lambda earlier, _, n=n: F.sum(f"_t_{n}").over(earlier)
        for n in changes:
            x = F.col(f"_x_{n}")
            totals[f"_t_{n}"] = F.max_by(x, F.when(x.isNotNull(), position))
            scans[f"_c_{n}"] = lambda earlier, _, n=n: F.last(f"_t_{n}", ignorenulls=True).over(earlier)
        f = f.carry(totals, scans, keep)
        f = f.add(
            **{
                n: F.when(
                    F.col(f"_x_{n}").isNotNull(),
                    F.coalesce(F.col(f"_c_{n}"), F.lit(0.0)) + F.sum(f"_x_{n}").over(f.cum),
                )
                for n in sums
            },
            **{
                f"_p_{n}": F.coalesce(F.last(f"_x_{n}", ignorenulls=True).over(f.cum), f"_c_{n}")
                for n in changes
            },
        )
        if changes:
            f = f.add(
                **{
                    n: div(F.col(f"_p_{n}"), F.coalesce(F.lag(f"_p_{n}").over(f.w), f"_c_{n}")) - 1
                    for n in changes
                }
            )
        temporary = [f"_{k}_{n}" for n in {**sums, **changes} for k in "xc"] + [f"_p_{n}" for n in changes]
        return f.drop(*temporary)

    def positions(self, keep: int = 0, pos: str = "pos", n: str = "n") -> Frame:
        """0-based position of each row in its series, and the length of the series."""
        f = self.carry(
            {"_t_n": F.count(F.lit(1))},
            {
                "_c_n": lambda earlier, _: F.sum("_t_n").over(earlier),
                n: lambda _, every: F.sum("_t_n").over(every),
            },
            keep,
        )
        return f.add(
            **{pos: F.coalesce(F.col("_c_n"), F.lit(0)) + F.row_number().over(f.w) - 1}
        ).drop("_c_n")
