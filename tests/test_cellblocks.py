"""Cells in blocks against the single operators in long form."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import cellblocks as C
from barloom.operators import forest as R
from barloom.operators import symbol_models as M
from barloom.operators import transforms as T

HOUR, ROWS, COLUMNS = 3600, 16, ["open", "still", "odd"]


def bars(lengths=(70, 3, 48)):
    """Series of some and of few bars; one column does not move, one has zeros, nulls and infinities."""
    r, parts = np.random.default_rng(5), []
    for s, n in zip("ABC", lengths, strict=True):
        d = pd.DataFrame({"symbol": s, "bar_ts": pd.date_range("2024-01-01 05:00", periods=n, freq="h")})
        d["open"], d["still"] = 100 + np.cumsum(r.standard_normal(n)), 7.25
        d["close"] = 100 + np.cumsum(r.choice([-1.0, 1.0], n))
        d["odd"] = r.choice([0.0, -3.0, 1e300, np.inf, np.nan, 2.5], n)
        d["volume"], d["variance"] = r.choice([0.0, 1.0, 5.0], n), r.random(n)
        parts.append(d)
    return pd.concat(parts)


def sorted_cells(df):
    return df.select("symbol", "feature", "bar_ts", "value").toPandas().sort_values(["symbol", "feature", "bar_ts"]).reset_index(drop=True)


def same(a, b, rtol=1e-9):
    a, b = sorted_cells(a), sorted_cells(b)
    assert a.drop(columns="value").equals(b.drop(columns="value"))
    np.testing.assert_allclose(a.value, b.value, rtol=rtol, atol=1e-9)


@pytest.fixture(scope="module")
def made(spark):
    base = spark.createDataFrame(bars())
    return base, C.expand(base, HOUR, COLUMNS, rows=ROWS)


def long_form(base):
    return T.expand_smooth(T.expand_ratios(T.to_long(base, COLUMNS, keep=("volume", "variance"))), HOUR, ROWS)


def test_expanded_cells_and_one_row_per_series_and_block(made):
    base, blocks = made
    same(C.to_long(blocks, HOUR), long_form(base))
    per = blocks.groupBy("symbol", "_b").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("values")).alias("most")).collect()
    assert {r.n for r in per} == {12 * len(COLUMNS)} and max(r.most for r in per) <= ROWS


def test_each_step_of_normalising(made):
    base, blocks = made
    calm = blocks.where(~F.col("feature").startswith("odd"))  # changes of values near 1e300 are all rounding
    keep = lambda df, c: df.select("symbol", "feature", "bar_ts", F.coalesce(c, F.lit(1e-7)).alias("value"))
    flat = C.detrend(calm)
    same(C.to_long(flat, HOUR), keep(T.col_detrend(C.to_long(calm, HOUR), HOUR, ROWS), "detrended"))
    scored = C.score(flat, ROWS)
    same(C.to_long(scored, HOUR), keep(T.zscore_expanding(C.to_long(flat, HOUR), HOUR, ROWS), "zscore"), 1e-6)
    same(C.to_long(C.winsorize(scored), HOUR), keep(T.winsorize_global(C.to_long(scored, HOUR)), "winsorized"))
    assert C.normalise(blocks, rows=ROWS).where(F.exists("values", lambda v: v.isNull() | F.isnan(v))).isEmpty()


def test_model_inputs_equal_those_from_long_cells(spark):
    base = spark.createDataFrame(bars((300, 260, 40)))
    blocks = C.expand(base, HOUR, ["open", "odd"])  # in blocks of the default length, which M.inputs takes for granted
    names = [r[0] for r in blocks.select("feature").distinct().orderBy("feature").collect()]
    shown = lambda d: d.table.select("symbol", "bar_ts", "bins", "labels", "roles").toPandas().sort_values(["symbol", "bar_ts"]).reset_index(drop=True).map(lambda v: v.tolist() if isinstance(v, np.ndarray) else v)
    a, b = M.inputs(blocks, base, HOUR, names), M.inputs(C.to_long(blocks, HOUR), base, HOUR, names)
    pd.testing.assert_frame_equal(shown(a), shown(b))
    assert len(shown(a)) == 600
    same(M.newest(blocks, base, 2, HOUR), M.newest(C.to_long(blocks, HOUR), base, 2))
    assert a.edges.count() == b.edges.count() and R.bin_edges(C.of_bars(blocks, base.limit(0), HOUR)).isEmpty()


def test_bars_with_gaps_are_refused(spark):
    holes = spark.createDataFrame(bars((20, 3, 5)).query("symbol != 'A' or bar_ts.dt.hour != 9"))
    with pytest.raises(Exception, match="are not one per"):
        C.expand(holes, HOUR, COLUMNS)
