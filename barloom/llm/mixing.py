"""Mixing: rake token weights to source, language and topic marginals, then draw documents at the calibrated rates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
# Topic rules in order: (topic, pattern over the whole text). The first that is found names the topic.
TOPICS = (
    ("legal", r"(?i)licen[cs]e|copyright"),
    ("contact", r"@|[0-9]{3}[-. ][0-9]{3,4}"),
    ("tabular", r" \| .* \| "),
)
OTHER = "prose"
DIMS = ("source", "lang", "topic")
UNKNOWN = "(null)"
SETTLED = 1e-10  # marginals that miss their targets by no more than this are met


def topic(text: Column) -> Column:
    out = F.lit(OTHER)
    for name, pattern in reversed(TOPICS):
        out = F.when(F.rlike(text, F.lit(pattern)), name).otherwise(out)
    return out


def tokens(text: Column) -> Column:
    """Number of words of the whole text; 0 for null."""
    inner = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    n = F.size(F.split(inner, r"[\x20\x09-\x0D]+"))
    return F.when(text.isNull() | (inner == ""), 0).otherwise(n).cast("long")


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, n_tokens, source, lang, topic); nulls in a dimension form a group of their own."""
    text = F.col(text_col)
    dims = [F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)).alias(c) for c in DIMS[:2]]
    return docs.select(F.col(id_col).alias("_id"), tokens(text).alias("n_tokens"), *dims, topic(text).alias("topic"))


def tempered(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """Target share of each value: its token share to the power, scaled to sum 1 (power 0: uniform)."""
    per = cells.groupBy(dim).agg(F.sum("n").alias("n")).select(dim, F.pow(F.col("n"), F.lit(float(power))).alias("v"))
    return per.crossJoin(per.agg(F.sum("v").alias("all"))).select(dim, (F.col("v") / F.col("all")).alias("share"))


def goal(target: DataFrame, dim: str) -> DataFrame:
    """(value, share) of a caller's targets: shares of a repeated value add up, a null share is no target, a null value is the group of nulls."""
    value = F.coalesce(F.col(dim).cast("string"), F.lit(UNKNOWN)).alias(dim)
    return target.where("share is not null").groupBy(value).agg(F.sum(F.col("share").cast("double")).alias("share"))


def marginal_errors(w: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """(dim, error): the largest difference of a value's weight from its target share; values without a target do not count."""
    parts = [
        w.groupBy(dim).agg(F.sum("w").alias("_have")).join(t, dim).agg(F.lit(dim).alias("dim"), F.max(F.abs(F.col("_have") - F.col("share"))).alias("error"))
        for dim, t in targets.items()
    ]
    return reduce(DataFrame.union, parts)


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int) -> DataFrame:
    """Iterative proportional fitting: (dims, n, w) with w starting at n and scaled to each marginal in turn.

    Sweeps end when one found all marginals met, or after `sweeps` of them. Each step aggregates
    weights by one dimension and joins the factors back, for any number of cells, and is a table of
    its own, so that plans stay short. A value without a target, or without weight, keeps its weight.
    """
    w = cells.withColumn("w", F.col("n").cast("double"))
    for _ in range(sweeps):
        worst = 0.0
        for dim, target in targets.items():
            have = w.groupBy(dim).agg(F.sum("w").alias("_have")).join(target, dim, "left")
            worst = max(worst, have.agg(F.max(F.abs(F.col("_have") - F.col("share")))).first()[0] or 0.0)  # one number
            factor = have.select(dim, F.coalesce(F.try_divide("share", "_have"), F.lit(1.0)).alias("_f"))
            w = materialize(w.join(factor, dim).withColumn("w", F.col("w") * F.col("_f")).drop("_f"), "rake")
        if worst <= SETTLED:
            break
    return w


def unit(id_: Column) -> Column:
    """A fixed number in [0, 1) for an id, the same in every run."""
    return F.conv(F.substring(F.md5(id_.cast("string")), 1, 13), 16, 10).cast("double") / float(16**13)


def mix(
    docs: DataFrame,
    powers: dict[str, float] | None = None,
    fraction: float = 0.5,
    sweeps: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    targets: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """Draw documents so that expected tokens meet the marginals: (id, n_tokens, source, lang, topic, rate, copies).

    `targets` maps a dimension to (value, share); a dimension without one gets its token shares to
    the power in `powers`. The draw aims at `fraction` of all tokens. A document's `rate` is the
    target tokens of its cell over the cell's tokens; `copies` is rate rounded down, plus one with
    the probability of the rest (by a fixed hash of the id). Rows with no copy are not returned:
    that is the sampling. Rates above 1 mean repeats, so no mass is cut off.

    Shares of a repeated value add up, and a null share is no target. Null dimensions form the group
    "(null)". Documents without words have no weight and are not
    drawn. Null ids share one draw. Repeated rows are documents of their own that are drawn alike.
    An empty table gives an empty result; other columns of the input are not read.
    """
    d = materialize(described(docs, id_col, text_col), "described")
    powers = {"source": 0.5, "lang": 0.7, "topic": 0.5} if powers is None else powers
    cells = materialize(d.groupBy(*DIMS).agg(F.sum("n_tokens").alias("n")).where("n > 0"), "cells")
    given = {dim: goal(t, dim) for dim, t in (targets or {}).items()}
    goals = {dim: materialize(given[dim] if dim in given else tempered(cells, dim, powers[dim]), "goals") for dim in DIMS}
    w = rake(cells, goals, sweeps)
    # Two one-row totals, so this cross join adds columns and no rows.
    total = w.agg(F.sum("w").alias("_w"), F.sum("n").alias("_n"))
    rates = w.crossJoin(total).select(*DIMS, (F.col("w") / F.col("_w") * F.col("_n") * fraction / F.col("n")).alias("rate"))
    out = d.where("n_tokens > 0").join(materialize(rates, "rates"), list(DIMS))
    draw = F.floor("rate") + F.when(unit(F.col("_id")) < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    out = out.withColumn("copies", F.coalesce(draw, F.floor("rate")).cast("long")).where("copies > 0")
    return out.select(F.col("_id").alias(id_col), "n_tokens", *DIMS, "rate", "copies")


def sql(powers: dict[str, float] | None = None, fraction: float = 0.5, sweeps: int = 8) -> str:
    """The same rows in DuckDB, with every scaling step as a named table."""
    powers = {"source": 0.5, "lang": 0.7, "topic": 0.5} if powers is None else powers
    cases = " ".join(f"when regexp_matches(text, '{p}') then '{t}'" for t, p in TOPICS)
    parts = [
        f"""d as materialized (select doc_id, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::bigint as n_tokens,
            coalesce(source, '{UNKNOWN}') as source, coalesce(lang, '{UNKNOWN}') as lang, case {cases} else '{OTHER}' end as topic
            from documents)""",
        "w0 as materialized (select source, lang, topic, sum(n_tokens)::bigint as n, sum(n_tokens)::double as w from d group by all having sum(n_tokens) > 0)",
    ]
    for dim in DIMS:
        parts.append(
            f"""t_{dim} as materialized (select {dim}, v / sum(v) over () as share from
                (select {dim}, pow(sum(n)::double, {powers[dim]}) as v from w0 group by {dim}))"""
        )
    k = 0
    for _ in range(sweeps):
        for dim in DIMS:
            parts.append(
                f"""w{k + 1} as materialized (select source, lang, topic, n, w * share / sum(w) over (partition by {dim}) as w
                    from w{k} join t_{dim} using ({dim}))"""
            )
            k += 1
    parts.append(f"r as (select source, lang, topic, w / sum(w) over () * sum(n) over () * {fraction} / n as rate from w{k})")
    return f"""with {", ".join(parts)},
    drawn as (select doc_id, n_tokens, source, lang, topic, rate,
        (floor(rate) + case when ('0x' || substr(md5(doc_id::varchar), 1, 13))::bigint / {float(16**13)!r} < rate - floor(rate)
                            then 1 else 0 end)::bigint as copies
        from d join r using (source, lang, topic) where n_tokens > 0)
    select * from drawn where copies > 0"""
