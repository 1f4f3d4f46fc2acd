"""Cells of the batch form in blocks: one row per series and block, its values in an array.

At 684 series per bar, a row per cell is mostly the names of its series, moved and sorted again by
every step. Here a row holds a series' values in up to `rows` consecutive bars: (symbol, feature,
_b, _first, values), where `_first` is the first bar's number on the grid. Steps work on the arrays
of a row; what they need of other blocks is gathered from one summary row per block, as in
frames.py, and comes back by a join. The results are those of the single operators in transforms.py.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.numeric import FILLER
from barloom.operators import transforms as T
from barloom.operators.frames import BLOCK_ROWS, Frame, grid_index, grid_time, micros
from barloom.operators.orderstats import order_statistics
from barloom.session import materialize

KEYS = T.KEYS
SERIES = "symbol string, feature string, _b long, _first long, values array<double>"
ROW = ("symbol", "feature", "_b", "_first", "values")
HALO = 4  # rows that the smoothing looks back and ahead
TOGETHER = 256  # arrays that a task works on at a time
LINE = ("_n", "_mx", "_my", "_vx", "_cxy")
MOMENTS = ("_n", "_m", "_v", "_end")


def is_blocks(cells: DataFrame) -> bool:
    return "values" in cells.columns


def to_long(blocks: DataFrame, period: float) -> DataFrame:
    """One row per cell: (symbol, feature, bar_ts, value)."""
    each = blocks.select("symbol", "feature", "_first", F.posexplode("values").alias("_at", "value"))
    return each.select("symbol", "feature", grid_time(F.col("_first") + F.col("_at"), period).alias("bar_ts"), "value")


def _clean(x: np.ndarray) -> np.ndarray:
    return np.where(np.isfinite(x), x, FILLER)


def _shift(x: np.ndarray, first: np.ndarray | float) -> np.ndarray:
    """Each column's predecessor; `first` before the first."""
    out = np.empty_like(x)
    out[:, 1:], out[:, 0] = x[:, :-1], first
    return out


def _lists(x: np.ndarray, lengths: np.ndarray) -> pa.Array:
    flat = x.ravel() if (lengths == x.shape[1]).all() else x[np.arange(x.shape[1]) < lengths[:, None]]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(flat))


def _matrix(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The arrays as rows, filled up with NaN, and their lengths."""
    lengths, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
    out = np.full((len(lengths), int(lengths.max(initial=0))), np.nan)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out, lengths


def _each(step: Callable[[pa.RecordBatch, np.ndarray], tuple[np.ndarray, dict[str, np.ndarray]]]):
    """A step over matrices as a function of Arrow batches: new values, and summary columns (NaN: null)."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, TOGETHER):
                b = whole.slice(lo, TOGETHER)
                x, lengths = _matrix(b.column("values"))
                with np.errstate(all="ignore"):
                    values, extra = step(b, x)
                columns = [*[b.column(c) for c in ("symbol", "feature", "_b", "_first")], _lists(values, lengths)]
                more = [pa.array(v, from_pandas=True) for v in extra.values()]
                yield pa.RecordBatch.from_arrays([*columns, *more], ["symbol", "feature", "_b", "_first", "values", *extra])

    return apply


def _column(b: pa.RecordBatch, name: str) -> np.ndarray:
    """A column beside the arrays, upright."""
    return b.column(name).to_numpy(zero_copy_only=False).astype(float)[:, None]


def expand(base: DataFrame, period: float, columns: Sequence[str], by: Sequence[str] = ("volume", "variance"), rows: int = BLOCK_ROWS) -> DataFrame:
    """Wide gap-free bars to the blocks of all their cells, with the moments of each block's line; written.

    Every column, its ratios to the columns `by`, and of each its Savitzky-Golay smoothing, 5-bar
    mean and relative change, cleaned.
    """
    names = list(dict.fromkeys([*columns, *by]))
    wide = base.select("symbol", "bar_ts", *[F.col(c).cast("double").alias(c) for c in names])
    f = Frame.of(wide, period, before=HALO, after=HALO, rows=rows)
    series = [f"{c}{by_}" for c in columns for by_ in ("", *[f"_div_{d}" for d in by])]
    features = pa.array([f"{s}{v}" for s in series for v in ("", "_savgol", "_smooth_5", "_diff")])
    step = micros(period)

    def block(t: pa.Table) -> pa.Table:
        b = t.column("_b")[0].as_py()
        t = t.sort_by("_i")
        i = t.column("_i").to_numpy()
        own = np.flatnonzero((i >= b * rows) & (i < (b + 1) * rows))
        if not len(own):
            return none
        if (np.diff(i) != 1).any() or (t.column("bar_ts").cast(pa.int64()).to_numpy() != i * step).any():
            raise ValueError(f"bars of {t.column('symbol')[0]} are not one per {period} seconds")
        x = np.stack([t.column(c).to_numpy().astype(float) for c in names])
        with np.errstate(all="ignore"):
            each = [v for c in columns for v in (x[names.index(c)], *[x[names.index(c)] / x[names.index(d)] for d in by])]
            cells = _smoothed(_clean(np.stack(each)), int(own[0]), int(own[-1]) + 1)
            at = i[own].astype(float)
            off = at - at.mean()
            mean = cells.mean(1)
            line = {"_n": len(own), "_mx": at.mean(), "_my": mean, "_vx": (off * off).mean(), "_cxy": ((cells - mean[:, None]) * off).mean(1)}
        n = len(features)
        whole = lambda v, kind: pa.array(np.broadcast_to(v, n), kind)
        return pa.Table.from_arrays(
            [pa.array([t.column("symbol")[0].as_py()] * n, pa.string()), features, whole(b, pa.int64()), whole(i[own[0]], pa.int64()), _lists(cells, np.full(n, len(own))),
             whole(line["_n"], pa.int64()), *[whole(line[c], pa.float64()) for c in LINE[1:]]],
            schema=kinds,
        )

    double = pa.float64()
    kinds = pa.schema([("symbol", pa.string()), ("feature", pa.string()), ("_b", pa.int64()), ("_first", pa.int64()), ("values", pa.list_(double)), ("_n", pa.int64()), *[(c, double) for c in LINE[1:]]])
    none = kinds.empty_table()
    out = f.df.groupBy("symbol", "_b").applyInArrow(block, f"{SERIES}, _n long, " + ", ".join(f"{c} double" for c in LINE[1:]))
    return materialize(out, "expanded")


def _smoothed(x: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Rows of x and their variants, four rows each, for the columns from lo to hi."""
    pad = np.full((len(x), x.shape[1] + 2 * HALO), np.nan)
    pad[:, HALO:-HALO] = x
    at = lambda k: pad[:, HALO + k + lo : HALO + k + hi]
    there = lambda k: (np.arange(lo, hi) + k >= 0) & (np.arange(lo, hi) + k < x.shape[1])

    def fit(weights: Sequence[int], over: int, start: int, step: int) -> np.ndarray:
        return sum((float(w) * at(start + step * j) for j, w in enumerate(weights)), 0.0) / float(over)

    savgol = np.where(there(-2) & there(2), fit(T.SAVGOL_MIDDLE, 35, -2, 1), np.nan)
    done = there(-2) & there(2)
    for here, weights, over, start, step in (
        (~there(-1), T.SAVGOL_FIRST, 70, 0, 1),
        (~there(-2) & there(3), T.SAVGOL_SECOND, 35, -1, 1),
        (~there(1), T.SAVGOL_FIRST, 70, 0, -1),
        (~there(2) & there(-3), T.SAVGOL_SECOND, 35, 1, -1),
    ):
        here = here & ~done
        if here.any():
            savgol = np.where(here, fit(weights, over, start, step), savgol)
        done = done | here
    mean = (at(-4) + at(-3) + at(-2) + at(-1) + at(0)) / 5
    change = at(0) / at(-1)
    change = np.where(np.isfinite(change), change, np.nan) - 1
    return np.stack([at(0), _clean(savgol), _clean(mean), _clean(change)], 1).reshape(4 * len(x), hi - lo)


def detrend(blocks: DataFrame) -> DataFrame:
    """Values less their straight line over the series, with the moments of each block's logs; written. See T.col_detrend."""
    lines = T.lines(blocks.select(*KEYS, "_b", *LINE), KEYS).groupBy(*KEYS).agg(*[F.first(c).alias(c) for c in ("_gx", "_gy", "_slope")])

    def step(b: pa.RecordBatch, x: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        gy = _column(b, "_gy")
        rise = _column(b, "_slope") * (_column(b, "_first") + np.arange(x.shape[1]) - _column(b, "_gx"))
        left = x - (gy + rise)
        noise = np.abs(left) <= T.ROUNDING * np.maximum(np.abs(x), np.abs(gy) + np.abs(rise))
        flat = np.where(np.isnan(x), np.nan, _clean(np.where(noise, 0.0, left)))
        first, n, mean, squares, logs = _logs(flat)
        last = np.where(np.isnan(logs), -1, np.arange(x.shape[1])).max(1, initial=-1)
        empty = n[:, -1] == 0
        end = np.where(empty, np.nan, logs[np.arange(len(x)), last])
        return flat, {
            "_n": n[:, -1].astype(np.int64), "_m": np.where(empty, np.nan, first[:, 0] + mean[:, -1]),
            "_v": np.where(empty, np.nan, squares[:, -1] / n[:, -1]), "_end": end,
        }

    out = blocks.select(*ROW).join(materialize(lines, "lines"), list(KEYS))
    return materialize(out.mapInArrow(_each(step), f"{SERIES}, _n long, _m double, _v double, _end double"), "detrended")


def _logs(x: np.ndarray):
    """A row's first log, the running count, mean and squared deviations of the logs less that one, and the logs."""
    logs = np.where(x > 0, np.log(np.where(x > 0, x, 1.0)), np.nan)
    there = ~np.isnan(logs)
    first = np.where(there.any(1), logs[np.arange(len(x)), there.argmax(1)], 0.0)[:, None]
    d = np.where(there, logs - first, 0.0)
    n = there.cumsum(1).astype(float)
    mean = np.where(n > 0, d.cumsum(1) / np.maximum(n, 1), 0.0)
    squares = np.where(there, (d - _shift(mean, 0.0)) * (d - mean), 0.0).cumsum(1)
    return first, n, mean, squares, logs


def score(blocks: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """Relative change of the logs' z-scores against everything seen so far; written. See T.zscore_expanding."""
    part = blocks.select(*KEYS, "_b", *MOMENTS)
    state = T.earlier_moments(part, Frame(part, KEYS, ("_i",), rows))
    state = state.select(*KEYS, "_b", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("_n0", "_m0", "_s0")], "_z0")

    def step(b: pa.RecordBatch, x: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        n0, m0, s0, z0 = (_column(b, c) for c in ("_n0", "_m0", "_s0", "_z0"))
        first, n1, mean, squares, logs = _logs(x)
        m1 = np.where(n1 > 0, first + mean, 0.0)
        n = n0 + n1
        squares = s0 + squares + np.where(n > 0, n0 * n1 / np.maximum(n, 1), 0.0) * (m1 - m0) * (m1 - m0)
        sd = np.where(n > 1, np.sqrt(squares / np.maximum(n - 1, 1)), np.nan)
        z = (logs - (n0 * m0 + n1 * m1) / n) / sd
        known = np.maximum.accumulate(np.where(np.isfinite(z), np.arange(x.shape[1]), -1), 1)
        last = np.where(known >= 0, np.take_along_axis(z, np.maximum(known, 0), 1), z0)
        change = last / _shift(last, z0[:, 0])
        return _clean(np.where(np.isfinite(change), change, np.nan) - 1), {}

    out = blocks.select(*ROW).join(materialize(state, "moments"), [*KEYS, "_b"])
    return materialize(out.mapInArrow(_each(step), SERIES), "scored")


def winsorize(blocks: DataFrame, p: float = 0.10) -> DataFrame:
    """Clamp the lowest and highest share p of all cells together. See T.winsorize_global."""
    counts = blocks.groupBy(F.lit(0).alias("_g")).agg(F.sum(F.size("values")).alias("n"))
    each = blocks.select(F.lit(0).alias("_g"), F.explode("values").alias("value"))
    limits = order_statistics(each, ["_g"], "value", T.limit_ranks(counts, p), few=True)
    pair = F.broadcast(limits.groupBy("_g").pivot("name", ["low", "high"]).agg(F.first("value")))
    clamped = F.transform("values", lambda v: F.least(F.greatest(v, F.col("low")), F.col("high")))
    return blocks.withColumn("_g", F.lit(0)).join(pair, "_g").select(*ROW[:-1], clamped.alias("values"))


def normalise(blocks: DataFrame, p: float = 0.10, rows: int = BLOCK_ROWS) -> DataFrame:
    """Detrend, expanding z-score and winsorise over all cells of `expand`. See T.normalise."""
    return winsorize(score(detrend(blocks), rows), p)


def of_bars(blocks: DataFrame, bars: DataFrame, period: float, rows: int = BLOCK_ROWS) -> DataFrame:
    """Long cells of the given bars (symbol, bar_ts) alone: only their places in the arrays are taken out. `rows` as in `expand`."""
    i = grid_index("bar_ts", period)
    wanted = bars.select("symbol", F.floor(i / rows).cast("long").alias("_b"), i.alias("_i")).groupBy("symbol", "_b").agg(F.collect_set("_i").alias("_is"))
    at = F.transform("_is", lambda k: (k - F.col("_first")).cast("int"))
    inside = F.filter(at, lambda k: (k >= 0) & (k < F.size("values")))
    taken = F.transform(inside, lambda k: F.struct((F.col("_first") + k).alias("_i"), F.get("values", k).alias("value")))
    each = blocks.join(wanted, ["symbol", "_b"]).select("symbol", "feature", F.explode(taken).alias("_c"))
    return each.select("symbol", "feature", grid_time("_c._i", period).alias("bar_ts"), F.col("_c.value").alias("value"))


def binned(blocks: DataFrame, edges: DataFrame, names: Sequence[str], period: float) -> DataFrame:
    """(symbol, bar_ts, bins): one byte per feature, the number of edges below the value. See forest.binned."""
    n = len(names)
    order = blocks.sparkSession.createDataFrame(list(enumerate(names)), "_k int, feature string")

    def digits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, edges = b.column("values"), b.column("edges")
            found = [
                np.searchsorted(edges[r].values.to_numpy(zero_copy_only=False), values[r].values.to_numpy(zero_copy_only=False)).astype(np.uint8).tobytes()
                for r in range(b.num_rows)
            ]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(found, pa.binary())], [*b.schema.names[:4], "digits"])

    def rows(t: pa.Table) -> pa.Table:
        series = t.column("digits").to_pylist()
        out = np.zeros((len(series[0]), n), np.uint8)
        out[:, t.column("_k").to_numpy()] = np.frombuffer(b"".join(series), np.uint8).reshape(len(series), -1).T
        first = t.column("_first")[0].as_py()
        return pa.table({
            "symbol": pa.array([t.column("symbol")[0].as_py()] * len(out), pa.string()),
            "_i": pa.array(np.arange(first, first + len(out))), "bins": pa.array([x.tobytes() for x in out], pa.binary()),
        })

    small = materialize(edges.join(order, "feature"), "edges-in-order")  # a row per series
    cut = blocks.join(small, list(KEYS)).select("symbol", "_b", "_first", "_k", "values", "edges")
    cut = cut.mapInArrow(digits, "symbol string, _b long, _first long, _k int, digits binary")
    packed = cut.groupBy("symbol", "_b").applyInArrow(rows, "symbol string, _i long, bins binary")
    return packed.select("symbol", grid_time("_i", period).alias("bar_ts"), "bins")
