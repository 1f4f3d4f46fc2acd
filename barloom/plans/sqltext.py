"""Shared pieces of the DuckDB texts: input views, bars, rolling expressions."""

from __future__ import annotations


def rounded(expr: str, name: str | None = None) -> str:
    """Twelve digits, then seven with ties away from zero, as `signif` gives them.

    printf breaks ties by the binary value; the factor, smaller than the twelfth digit, puts those
    that the first step left exactly on a tie above it. Only this text has it.
    """
    clean = f"case when abs({expr}) < 1e-12 then 0.0::double else cast(printf('%.11e', {expr}) as double) end"
    return f"cast(printf('%.6e', ({clean}) * 1.0000000000001::double) as double) as {name or expr}"


def cols(*names: str) -> str:
    return ", ".join(rounded(n) for n in names)


def keyed(*names: str) -> str:
    return "symbol, bar_ts, " + cols(*names)


W = "(partition by symbol order by bar_ts rows {lo} preceding)"


def win(n: int) -> str:
    return f"(partition by symbol order by bar_ts rows between {n - 1} preceding and current row)"


CUM = "(partition by symbol order by bar_ts rows between unbounded preceding and current row)"
BEFORE = "(partition by symbol order by bar_ts rows between unbounded preceding and 1 preceding)"
SEQ = "(partition by symbol order by bar_ts)"
ALL = "(partition by symbol)"


def ma(x: str, n: int) -> str:
    return f"(case when count({x}) over {win(n)} = {n} then avg({x}) over {win(n)} end)"


def total(x: str, n: int) -> str:
    return f"(case when count({x}) over {win(n)} = {n} then sum({x}) over {win(n)} end)"


def _dev(kind: str, x: str, n: int) -> str:
    w = win(n)
    return (
        f"(case when count({x}) over {w} = {n} then "
        f"case when min({x}) over {w} = max({x}) over {w} then 0.0 else {kind}({x}) over {w} end end)"
    )


def sd(x: str, n: int) -> str:
    return _dev("stddev_samp", x, n)


def sdp(x: str, n: int) -> str:
    return _dev("stddev_pop", x, n)


def ln(x: str) -> str:
    return f"(case when {x} > 0 then ln({x}) end)"


def root(x: str) -> str:
    return f"(case when {x} >= 0 then sqrt({x}) end)"


def ratio(x: str, y: str) -> str:
    return f"({x} / nullif({y}, 0))"


def chain(*steps: tuple[str, str]) -> str:
    """WITH list from (name, body) pairs."""
    return "with " + ",\n".join(f"{n} as ({b})" for n, b in steps) + "\n"


TRADES = (
    "trades",
    """select event_type as symbol, ts, event_id as seq, value as price,
              cast(json_extract_string(props, '$.k') as double) as size from events""",
)

TRADES_WIDE = (
    "trades_wide",
    """select 'U' || user_id as symbol, ts, event_id as seq, value as price,
              cast(json_extract_string(props, '$.k') as double) as size from events""",
)

TRADES_DAILY = (
    "trades_daily",
    """select 'S' || l_suppkey as symbol, l_shipdate as ts, l_orderkey * 8 + l_linenumber as seq,
              l_extendedprice / l_quantity as price, l_quantity as size from lineitem""",
)


def sparse(period: int, source: str = "trades") -> tuple[str, str]:
    return (
        "sparse",
        f"""select symbol, time_bucket(interval '{period} seconds', ts) as bar_ts,
               first(price order by ts, seq) as open, max(price) as high, min(price) as low,
               last(price order by ts, seq) as close, sum(size) as volume
        from {source} group by 1, 2""",
    )


def grid(period: int, name: str = "sparse") -> tuple[str, str]:
    return (
        "grid",
        f"""select symbol, unnest(generate_series(min(bar_ts), max(bar_ts), interval '{period} seconds')) as bar_ts
        from {name} group by symbol""",
    )


FILLED = (
    "bars",
    f"""select g.symbol, g.bar_ts,
           last_value(open ignore nulls) over w as open, last_value(high ignore nulls) over w as high,
           last_value(low ignore nulls) over w as low, last_value(close ignore nulls) over w as close,
           coalesce(volume, 0) as volume
    from grid g left join sparse s on g.symbol = s.symbol and g.bar_ts = s.bar_ts
    window w as (partition by g.symbol order by g.bar_ts rows between unbounded preceding and current row)""",
)


def bars(period: int, view: tuple[str, str] = TRADES) -> list[tuple[str, str]]:
    return [view, sparse(period, view[0]), grid(period), FILLED]


def pad(x: str, name: str) -> str:
    return f"last_value({x} ignore nulls) over {CUM} as {name}"


def pct(padded: str) -> str:
    """Relative change of a column that is already filled forward."""
    return f"({padded} / nullif(lag({padded}) over {SEQ}, 0) - 1)"
