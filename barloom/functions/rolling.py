"""Rolling statistics over the last n rows, given by column name. A gap in the window gives NULL.

A Frame computes them from lag() columns (see Frame.roll). Each lag costs one step per row, and one
set of lags serves every statistic of a column, while a sliding aggregate starts over at every row.
NULLs need no counting: one missing value makes the sum NULL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rolling:
    kind: str  # mean, total, std or std_pop
    x: str
    n: int

    def values(self) -> list[Column]:
        """The window's values, oldest first."""
        return [F.col(lag_name(self.x, k)) for k in range(self.n - 1, 0, -1)] + [F.col(self.x)]

    @property
    def center(self) -> str:
        return f"_c{self.n}_{self.x}"

    def center_value(self) -> Column:
        """Mean distance from the newest value: exactly 0 where nothing moves."""
        return add_up([v - F.col(self.x) for v in self.values()]) / self.n

    def value(self) -> Column:
        if self.kind == "total":
            return add_up(self.values())
        if self.kind == "mean":
            return add_up(self.values()) / self.n
        d = [v - F.col(self.x) - F.col(self.center) for v in self.values()]
        return F.sqrt(add_up([e * e for e in d]) / (self.n - (1 if self.kind == "std" else 0)))


def lag_name(x: str, k: int) -> str:
    return f"_lag{k}_{x}"


def add_up(terms: list[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def mean(x: str, n: int) -> Rolling:
    return Rolling("mean", x, n)


def total(x: str, n: int) -> Rolling:
    return Rolling("total", x, n)


def std(x: str, n: int) -> Rolling:
    """Sample deviation."""
    return Rolling("std", x, n)


def std_pop(x: str, n: int) -> Rolling:
    return Rolling("std_pop", x, n)
