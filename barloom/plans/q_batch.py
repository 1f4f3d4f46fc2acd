"""Cells of the batch job: all 684 columns, and normalised."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import transforms as T
from barloom.plans import batch
from barloom.plans import sqltext as S
from barloom.plans.catalog import HOUR, present, query
from barloom.plans.q_base import BASE_SQL, CELLS_SQL, base
from barloom.plans.q_transforms import SAVGOL, SCORES


def by_cell(text: str) -> str:
    return text.replace("partition by symbol", "partition by symbol, feature")


def clean(x: str) -> str:
    return f"coalesce(case when isfinite({x}) then {x} end, 1e-7)"


EXPANDED = [
    BASE_SQL,
    CELLS_SQL,
    (
        "c1",
        f"""select symbol, bar_ts, feature, value from cells
            union all select symbol, bar_ts, feature || '_div_volume', {clean("value / nullif(by_volume, 0)")} from cells
            union all select symbol, bar_ts, feature || '_div_variance', {clean("value / nullif(by_variance, 0)")} from cells""",
    ),
    (
        "c2",
        by_cell(f"""select *, row_number() over {S.SEQ} as i, count(*) over {S.ALL} as n, {S.ma("value", 5)} as smooth_5,
                    {S.pct("value")} as diff from c1"""),
    ),
    ("c3", by_cell(f"select *, {SAVGOL} from c2")),
    (
        "expanded",
        "select symbol, bar_ts, feature, value from c3"
        + "".join(f" union all select symbol, bar_ts, feature || '_{v}', {clean(v)} from c3" for v in ("savgol", "smooth_5", "diff")),
    ),
]

NORMALISED = [
    *EXPANDED,
    ("d1", by_cell(f"select *, row_number() over {S.SEQ} as i from expanded")),
    ("d2", by_cell(f"select *, regr_slope(value, i) over {S.ALL} as b, avg(value) over {S.ALL} as my, avg(i) over {S.ALL} as mx from d1")),
    ("d3", "select symbol, feature, bar_ts, value, my, b * (i - mx) as rise from d2"),
    (
        "d4",
        f"""select symbol, feature, bar_ts, {clean("flat")} as value from (
            select *, case when abs(value - (my + rise)) > {T.ROUNDING!r} * greatest(abs(value), abs(my) + abs(rise)) then value - (my + rise)
                           else 0.0 end as flat from d3)""",
    ),
    *[(name, by_cell(f"select *, {added} from {prior}")) for name, added, prior in zip(("z1", "z2", "z3", "z4"), SCORES, ("d4", "z1", "z2", "z3"), strict=True)],
    ("z5", f"select symbol, feature, bar_ts, {clean('zscore')} as value from z4"),
    ("v1", "select *, row_number() over (order by value) as r, count(*) over () as n from z5"),
    ("v2", "select max(case when r = floor(0.1 * n) + 1 then value end) as lo, max(case when r = n - floor(0.1 * n) then value end) as hi from v1"),
    ("normalised", "select symbol, feature, bar_ts, least(greatest(value, lo), hi) as value from z5, v2"),
]


@query("cells_expanded", S.chain(*EXPANDED) + f"select symbol, feature, bar_ts, {S.cols('value')} from expanded")
def cells_expanded(spark, sf_dir):
    """All 684 columns of the batch job, one row per cell."""
    return present(batch.expanded(base(spark, sf_dir), HOUR), "symbol", "feature", "bar_ts", "value")


@query("cells_normalised", S.chain(*NORMALISED) + "select symbol, feature, bar_ts, round(value, 4) as value from normalised")
def cells_normalised(spark, sf_dir):
    """All 684 columns, detrended, scored and winsorised together; four decimals, because a score is a difference of near numbers."""
    out = batch.cells(base(spark, sf_dir), HOUR)
    return present(out.withColumn("value", F.round("value", 4)), "symbol", "feature", "bar_ts", "value")
