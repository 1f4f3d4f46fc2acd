"""Column transforms over the long form of all 57 hourly base columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import fitted as P
from barloom.operators import labels as L
from barloom.operators import transforms as T
from barloom.plans import batch
from barloom.plans import sqltext as S
from barloom.plans.catalog import HOUR, present, query
from barloom.plans.q_base import BASE_SQL, CELLS_SQL, base
from barloom.session import materialize

COLUMNS = batch.BASE


def wide(spark, sf_dir):
    return base(spark, sf_dir)


def cells(spark, sf_dir, keep=()):
    """Long form of all base columns, written once: most transforms read it twice."""
    return materialize(T.to_long(wide(spark, sf_dir), COLUMNS, keep), "cells")


def long_sql(s: str) -> str:
    return s.replace("partition by symbol", "partition by symbol, feature")


WIDE = [BASE_SQL, ("wide", "select * from base"), CELLS_SQL]


def text(out: str, *steps: tuple[str, str]) -> str:
    chain, prior = list(WIDE), "cells"
    for name, added in steps:
        chain.append((name, long_sql(f"select *, {added} from {prior}")))
        prior = name
    return S.chain(*chain) + f"select symbol, feature, bar_ts, {S.cols(out)} from {prior}"


def show(df, out):
    return present(df, "symbol", "feature", "bar_ts", out)


RAW_SQL = "case when feature = 'spread2' and value = 0 then null else value end"


@query("sanitize", text("clean", ("t1", "coalesce(case when value > 0 then ln(value) end, 1e-7) as clean")))
def sanitize(spark, sf_dir):
    logs = cells(spark, sf_dir).withColumn("clean", F.ln("value"))
    return show(T.sanitize(logs, "clean"), "clean")


@query("lag_diff", text("diff", ("t1", f"value - lag(value) over {S.SEQ} as diff")))
def lag_diff(spark, sf_dir):
    return show(T.lag_diff(cells(spark, sf_dir), HOUR), "diff")


@query("pct_change", text("change", ("t1", f"{S.pad('nullif(value, 0)', 'p')}"), ("t2", f"{S.pct('p')} as change")))
def pct_change(spark, sf_dir):
    gaps = cells(spark, sf_dir).withColumn("value", F.nullif("value", F.lit(0.0)))
    return show(T.pct_change(gaps, HOUR), "change")


@query("col_div_volume", text("ratio", ("t1", f"{S.ratio('value', 'by_volume')} as ratio")))
def col_div_volume(spark, sf_dir):
    return show(T.col_div(T.to_long(wide(spark, sf_dir), COLUMNS, ["volume"]), "volume"), "ratio")


@query("col_div_variance", text("ratio", ("t1", f"{S.ratio('value', 'by_variance')} as ratio")))
def col_div_variance(spark, sf_dir):
    return show(T.col_div(T.to_long(wide(spark, sf_dir), COLUMNS, ["variance"]), "variance"), "ratio")


@query(
    "col_div_rolling",
    S.chain(
        *WIDE,
        ("m", f"select symbol, bar_ts, {S.ma('Volatility', 5)} as m5 from wide"),
        ("t1", f"select c.*, {S.ratio('value', 'm5')} as ratio from cells c join m using (symbol, bar_ts)"),
    )
    + f"select symbol, feature, bar_ts, {S.cols('ratio')} from t1",
)
def col_div_rolling(spark, sf_dir):
    return show(T.col_div_rolling(wide(spark, sf_dir), HOUR, COLUMNS), "ratio")


@query("col_smooth", text("smooth", ("t1", f"{S.ma('value', 5)} as smooth")))
def col_smooth(spark, sf_dir):
    return show(T.col_smooth(cells(spark, sf_dir), HOUR), "smooth")


@query("col_smooth_10", text("smooth", ("t1", f"{S.ma('value', 10)} as smooth")))
def col_smooth_10(spark, sf_dir):
    return show(T.col_smooth(cells(spark, sf_dir), HOUR, n=10), "smooth")


def _fit(weights, over, start, step):
    at = lambda k: f"{'lead' if k > 0 else 'lag'}(value, {abs(k)}) over {S.SEQ}" if k else "value"
    return "(" + " + ".join(f"{w} * {at(start + step * j)}" for j, w in enumerate(weights)) + f") / {over}.0"


SAVGOL = f"""case when n < 5 then null
    when i = 1 then {_fit(T.SAVGOL_FIRST, 70, 0, 1)} when i = 2 then {_fit(T.SAVGOL_SECOND, 35, -1, 1)}
    when i = n then {_fit(T.SAVGOL_FIRST, 70, 0, -1)} when i = n - 1 then {_fit(T.SAVGOL_SECOND, 35, 1, -1)}
    else {_fit(T.SAVGOL_MIDDLE, 35, -2, 1)} end as savgol"""


@query("col_savgol", text("savgol", ("t1", f"row_number() over {S.SEQ} as i, count(*) over {S.ALL} as n"), ("t2", SAVGOL)))
def col_savgol(spark, sf_dir):
    return show(T.col_savgol(cells(spark, sf_dir), HOUR), "savgol")


@query(
    "col_detrend",
    text(
        "detrended",
        ("t1", f"row_number() over {S.SEQ} as i"),
        ("t2", f"regr_slope(value, i) over {S.ALL} as b, avg(value) over {S.ALL} as my, avg(i) over {S.ALL} as mx"),
        ("t3", "value - (my + b * (i - mx)) as detrended"),
    ),
)
def col_detrend(spark, sf_dir):
    return show(T.col_detrend(cells(spark, sf_dir), HOUR), "detrended")


@query(
    "col_extrapolate",
    S.chain(
        *WIDE,
        ("t1", "select *, 10.0 - row_number() over (partition by symbol, feature order by bar_ts desc) as x from cells"),
        (
            "t2",
            """select symbol, feature, avg(value) + regr_slope(value, x) * (10.0 - avg(x)) as next_value
               from t1 where x >= 0 group by 1, 2""",
        ),
    )
    + f"select symbol, feature, {S.cols('next_value')} from t2",
)
def col_extrapolate(spark, sf_dir):
    long = T.to_long(wide(spark, sf_dir), COLUMNS)
    return present(T.col_extrapolate(long), "symbol", "feature", "next_value")


SCORES = (
    f"{S.ln('value')} as x",
    f"""(x - avg(x) over {S.CUM}) / nullif(case when min(x) over {S.CUM} = max(x) over {S.CUM} then 0.0
        else stddev_samp(x) over {S.CUM} end, 0) as z""",
    S.pad("z", "p"),
    f"{S.pct('p')} as zscore",
)


@query("zscore_expanding", text("zscore", *zip(("t1", "t2", "t3", "t4"), SCORES, strict=True), ("t5", "round(zscore, 6) as zscore")).replace("select *, round", "select * exclude (zscore), round"))
def zscore_expanding(spark, sf_dir):
    """Six decimals: the change of a score of a slow series is a difference of near numbers."""
    return show(T.zscore_expanding(cells(spark, sf_dir), HOUR).withColumn("zscore", F.round("zscore", 6)), "zscore")


def _winsor_sql(by: str) -> str:
    part = f"partition by {by}" if by else ""
    return S.chain(
        *WIDE,
        ("t1", f"select *, row_number() over ({part} order by value) as r, count(*) over ({part}) as n from cells"),
        (
            "t2",
            f"""select *, max(case when r = floor(0.1 * n) + 1 then value end) over ({part}) as lo,
                   max(case when r = n - floor(0.1 * n) then value end) over ({part}) as hi from t1""",
        ),
        ("t3", "select *, least(greatest(value, lo), hi) as winsorized from t2"),
    ) + f"select symbol, feature, bar_ts, {S.cols('winsorized')} from t3"


@query("winsorize_global", _winsor_sql(""))
def winsorize_global(spark, sf_dir):
    return show(T.winsorize_global(cells(spark, sf_dir)), "winsorized")


@query("winsorize_by_feature", _winsor_sql("symbol, feature"))
def winsorize_by_feature(spark, sf_dir):
    return show(T.winsorize_by_feature(cells(spark, sf_dir), HOUR), "winsorized")


@query(
    "minmax_norm",
    text(
        "norm",
        ("t1", f"min(value) over {S.ALL} as lo, max(value) over {S.ALL} as hi"),
        ("t2", f"2 * {S.ratio('(value - lo)', '(hi - lo)')} - 1 as norm"),
    ),
)
def minmax_norm(spark, sf_dir):
    return show(T.minmax_norm(cells(spark, sf_dir), HOUR), "norm")


@query(
    "signal_zscore",
    text("zscore", ("t1", f"{S.ratio(f'(value - avg(value) over {S.ALL})', f'stddev_pop(value) over {S.ALL}')} as zscore")),
)
def signal_zscore(spark, sf_dir):
    return show(T.signal_zscore(cells(spark, sf_dir), HOUR), "zscore")


TINY = 1e-7  # a mean that small against its values is shown as 0: its digits are the rounding of a sum
DESCRIBED = ("mean", "std", "min", "max", "p25", "p50", "p75")


@query(
    "describe_features",
    S.chain(
        *WIDE,
        (
            "t1",
            """select symbol, feature, count(value) as "count", avg(value) as mean, stddev_samp(value) as std,
                   min(value) as min, max(value) as max, quantile_cont(value, 0.25) as p25,
                   quantile_cont(value, 0.5) as p50, quantile_cont(value, 0.75) as p75 from cells group by 1, 2""",
        ),
    )
    + f"""select symbol, feature, "count", {S.cols(*DESCRIBED)}
          from (select * replace (case when abs(mean) < {TINY!r} * greatest(abs(min), abs(max)) then 0.0 else mean end as mean) from t1)""",
)
def describe_features(spark, sf_dir):
    out = T.describe_features(cells(spark, sf_dir))
    tiny = F.abs("mean") < TINY * F.greatest(F.abs("min"), F.abs("max"))
    return present(out.withColumn("mean", F.when(tiny, 0.0).otherwise(F.col("mean"))), "symbol", "feature", "count", *DESCRIBED)


# ---- fitted on the training rows ----------------------------------------------------------

TRAINED = [
    *WIDE,
    ("p0", f"select symbol, bar_ts, row_number() over {S.SEQ} - 1 as pos, count(*) over {S.ALL} as n from wide"),
    ("p1", "select *, cast(round_even(n / 2.0, 0) as bigint) as half from p0"),
    ("parts", "select symbol, bar_ts, pos, pos < half - ceil(half * cast(0.55 as double)) as train from p1"),
    ("c1", "select c.*, pos, train from cells c join parts using (symbol, bar_ts)"),
]


def on_train(spark, sf_dir):
    """All cells, and those of the training rows of the time split."""
    long = cells(spark, sf_dir)
    train = L.split_time(wide(spark, sf_dir).select("symbol", "bar_ts"), HOUR).where("split = 'train'").select("symbol", "bar_ts")
    return long, materialize(long.join(train, ["symbol", "bar_ts"], "left_semi"), "train-cells")


def fitted_sql(params: str, out: str, name: str) -> str:
    return (
        S.chain(*TRAINED, ("fit", f"select symbol, feature, {params} from c1 where train group by 1, 2"), ("done", f"select c.*, {out} as {name} from c1 c join fit using (symbol, feature)"))
        + f"select symbol, feature, bar_ts, {S.cols(name)} from done"
    )


@query(
    "col_detrend_train",
    fitted_sql(
        "coalesce(regr_slope(value, pos), 0) as b, avg(value) as my, avg(pos) as mx",
        f"case when abs(value - (my + b * (pos - mx))) > {T.ROUNDING!r} * greatest(abs(value), abs(my) + abs(b * (pos - mx))) then value - (my + b * (pos - mx)) else 0.0 end",
        "detrended",
    ),
)
def col_detrend_train(spark, sf_dir):
    long, train = on_train(spark, sf_dir)
    return show(P.detrend(long, P.fit_lines(train, HOUR), HOUR), "detrended")


@query(
    "signal_zscore_train",
    fitted_sql("avg(value) as m, case when min(value) = max(value) then 0.0 else stddev_pop(value) end as s", S.ratio("(value - m)", "s"), "zscore"),
)
def signal_zscore_train(spark, sf_dir):
    long, train = on_train(spark, sf_dir)
    return show(P.zscore(long, P.fit_moments(train), HOUR), "zscore")


@query("minmax_norm_train", fitted_sql("min(value) as lo, max(value) as hi", f"2 * {S.ratio('(value - lo)', '(hi - lo)')} - 1", "norm"))
def minmax_norm_train(spark, sf_dir):
    long, train = on_train(spark, sf_dir)
    return show(P.minmax(long, P.fit_range(train), HOUR), "norm")


@query(
    "winsorize_train",
    fitted_sql(
        "list_sort(list(value))[cast(floor(0.1 * count(*)) as bigint) + 1] as lo, list_sort(list(value))[count(*) - cast(floor(0.1 * count(*)) as bigint)] as hi",
        "least(greatest(value, lo), hi)",
        "winsorized",
    ),
)
def winsorize_train(spark, sf_dir):
    long, train = on_train(spark, sf_dir)
    return show(P.winsorize(long, P.fit_limits(train), HOUR), "winsorized")
