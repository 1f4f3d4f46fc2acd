"""Line dedup by distinct-site spread: lines that stand on many sites are boilerplate and are removed."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.session import materialize

BLANK = " \t\x0b\x0c\r"


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK))


def line_key(line: Column) -> Column:
    """128 bits of the line without blanks around it."""
    return F.struct(F.xxhash64(trimmed(line)).alias("x"), F.xxhash64(F.lit(17), trimmed(line)).alias("y"))


def boilerplate(lines: DataFrame, min_sites: int, log_k: int = 10) -> DataFrame:
    """Keys of lines on at least `min_sites` distinct sites, from (k, s) rows of line key and site hash.

    One HyperLogLog sketch per line and task merges by aggregation. Estimates further from the
    threshold than four standard errors decide; the rest gets an exact distinct count.
    """
    margin = 4 * 1.04 / sqrt(1 << log_k)
    sketched = lines.groupBy("k").agg(F.hll_sketch_agg("s", log_k).alias("h"))
    est = sketched.select("k", F.hll_sketch_estimate("h").alias("n")).where(F.col("n") >= min_sites * (1 - margin))
    est = materialize(est.select("k", (F.col("n") > min_sites * (1 + margin)).alias("sure")), "line-spread")
    near = lines.join(est.where("not sure").select("k"), "k", "left_semi")
    exact = near.groupBy("k").agg(F.countDistinct("s").alias("n")).where(F.col("n") >= min_sites)
    return materialize(est.where("sure").select("k").union(exact.select("k")), "line-boilerplate")


def dedup_lines(
    docs: DataFrame,
    min_sites: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    log_k: int = 10,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """(id, text without boilerplate lines, n_lines, n_removed, carried columns) per input row.

    A line is the text between newlines; it is compared without the blanks around it, and removed
    wherever it stands if it occurs on `min_sites` (two or more) distinct sites. Blank lines stay.
    Rows with a null site keep their lines out of the count but are cleaned, and so are rows with a
    null id. A null text gives null and no lines; an empty one has one (blank) line. Repeated rows
    are cleaned each and count once per site. Of other columns only those in `carry` are read.

    Lines seen on one site only are left out first, by the least and greatest site hash of a 64-bit
    line hash; that aggregates in every task before the shuffle. What is left is a small part of all
    lines, is written once, and feeds sketches, exact counts and the list of lines to cut per document.
    """
    extra = [F.col(c).alias(f"_x{k}") for k, c in enumerate(carry)]
    d = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(site_col).alias("_site"), *extra)
    own = F.array_distinct(F.transform(F.split("_text", "\n"), trimmed))  # a document's own repeats count once
    line = d.select("_id", "_site", F.explode(own).alias("line")).where("line <> ''")
    k = line_key(F.col("line"))
    keyed = line.select("_id", k["x"].alias("x"), k["y"].alias("y"), F.when(F.col("_site").isNotNull(), F.xxhash64("_site")).alias("s"))
    spread = keyed.groupBy("x").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).where("lo <> hi").select("x")
    several = keyed.join(spread, "x", "left_semi").select("_id", F.struct("x", "y").alias("k"), "s")
    several = materialize(several, "line-several")
    gone = boilerplate(several.where("s is not null"), min_sites, log_k)
    hits = several.join(gone, "k", "left_semi").groupBy("_id").agg(F.collect_set("k").alias("_gone"))
    hits = hits.withColumnRenamed("_id", "_doc")
    joined = d.join(hits, d["_id"].eqNullSafe(hits["_doc"]), "left")
    parts = F.split("_text", "\n")
    stay = F.filter(parts, lambda x: ~F.array_contains(F.col("_gone"), line_key(x)) | (trimmed(x) == ""))
    held = [f"_x{k}" for k in range(len(carry))]
    out = joined.select(*held, "_id", "_text", "_gone", parts.alias("_all"), F.when(F.col("_gone").isNotNull(), stay).alias("_kept"))
    n = F.when(F.col("_text").isNull(), 0).otherwise(F.size("_all")).cast("long")
    left = F.coalesce(F.when(F.col("_kept").isNotNull(), F.size("_kept")).cast("long"), n)
    text = F.when(F.col("_kept").isNull(), F.col("_text")).otherwise(F.array_join("_kept", "\n"))
    back = [F.col(x).alias(c) for x, c in zip(held, carry, strict=True)]
    return out.select(F.col("_id").alias(id_col), text.alias(text_col), n.alias("n_lines"), (n - left).alias("n_removed"), *back)


def sql(min_sites: int = 8) -> str:
    """The same rows in DuckDB, by an exact count for every line."""
    trim = "trim({}, ' ' || chr(9) || chr(11) || chr(12) || chr(13))"
    return f"""
    with line as (
        select doc_id, source, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as i
        from documents),
    gone as (
        select {trim.format("l")} as k from line where {trim.format("l")} <> ''
        group by 1 having count(distinct source) >= {min_sites}),
    marked as (select line.*, g.k is not null as cut from line left join gone g on {trim.format("l")} = g.k),
    per as (
        select doc_id, coalesce(string_agg(case when not cut then l end, chr(10) order by i), '') as text,
               count(*) as n_lines, sum(case when cut then 1 else 0 end)::bigint as n_removed
        from marked group by doc_id)
    select d.doc_id, p.text, coalesce(p.n_lines, 0) as n_lines, coalesce(p.n_removed, 0) as n_removed
    from documents d left join per p on d.doc_id = p.doc_id"""
