"""Merkle manifest of a dataset: a tree of digests per group, a root over the groups, a proof per row.

Levels are built by sibling-shift self-joins: every node is joined to the nodes at its computed
sibling indices, and the rows in slot zero emit the parents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.session import materialize

PLANNED = 4  # levels whose paths are handed down in one plan
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")  # fixed values: what a leaf covers, in this order


def empty() -> Column:
    return F.lit("").cast("binary")


def hexed(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def digest(text: Column) -> Column:
    """SHA-256 of a string's UTF-8 bytes, as 32 bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def framed(value: Column) -> Column:
    """A value with its length in front, so that no two rows have the same text; `-` for null."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_text(values: Sequence[Column]) -> Column:
    return F.concat(*[framed(v) for v in values])


def positions(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """`rows` with `_at`, a row's place (from 0) in its group, by the given order, nulls first.

    Ranges of the sorted table are numbered by themselves, and a group's rows before a range come
    from one count per (range, group), so that a group may span any number of tasks.
    """
    keys = [*group, *order]
    laid = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_n", F.monotonically_increasing_id())
    laid = materialize(laid, "ranges").withColumn("_range", F.shiftright("_n", 33))
    runs = laid.groupBy("_range", *group).agg(F.min("_n").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = f"sum(_rows) over (partition by {', '.join(group) or '1'} order by _range rows between unbounded preceding and 1 preceding)"
    runs = runs.withColumn("_before", F.expr(f"coalesce({earlier}, 0)")).select(
        F.col("_range").alias("_r"), *[F.col(g).alias(f"_g{k}") for k, g in enumerate(group)], "_first", "_before"
    )
    same = F.col("_range") == F.col("_r")
    for k, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_g{k}"))
    out = laid.join(runs, same).withColumn("_at", F.col("_n") - F.col("_first") + F.col("_before"))
    return out.select(*rows.columns, "_at")


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """`nodes` (_tree, _at, _digest, ...) with `_others`, the digests of the run's other nodes, left to right."""
    shifts = [F.col("_at").bitwiseXOR(F.lit(1))]
    if arity != 2:
        first = F.col("_at") - F.pmod("_at", F.lit(arity))
        shifts = [first + F.pmod(F.col("_at") + F.lit(j), F.lit(arity)) for j in range(1, arity)]
    out, known = nodes, nodes.select(F.col("_tree").alias("_t"), F.col("_at").alias("_s"), F.col("_digest").alias("_d"))
    found = []
    for j, at in enumerate(shifts):
        sibling = known.select("_t", "_s", F.col("_d").alias(f"_d{j}"))
        asked = out.withColumn("_ask", at)
        out = asked.join(sibling, (F.col("_tree") == F.col("_t")) & (F.col("_ask") == F.col("_s")), "left").drop("_t", "_s")
        out = out.withColumn(f"_p{j}", F.col("_ask")).drop("_ask")
        found.append(F.struct(F.col(f"_p{j}").alias("p"), F.coalesce(f"_d{j}", empty()).alias("d")))
    ordered = F.transform(F.array_sort(F.array(*found)), lambda x: x.d) if len(found) > 1 else F.array(found[0].d)
    joined = F.concat(*[ordered[j] for j in range(len(found))])
    return out.select(*nodes.columns, joined.alias("_others"))


def build(leaves: DataFrame, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """All levels of the trees with more than one node left, each (_tree, _at, _digest, _size, _others, ...), and the roots.

    `_size` is the number of nodes that the tree has on this level. Every level is a written table.
    """
    levels, done = [], leaves.where("_size = 1").select("_tree", "_digest")
    nodes = leaves.where("_size > 1")
    largest = leaves.agg(F.max("_size")).first()[0] or 0
    while largest > 1:
        level = materialize(with_siblings(nodes, arity), "manifest-level")
        levels.append(level)
        up = level.where(F.pmod("_at", F.lit(arity)) == 0).select(
            "_tree", (F.expr(f"_at div {arity}")).alias("_at"),
            digest(F.concat(hexed(F.col("_digest")), hexed(F.col("_others")))).alias("_digest"),
            F.expr(f"(_size + {arity - 1}) div {arity}").alias("_size"),
        )
        done = done.union(up.where("_size = 1").select("_tree", "_digest"))
        nodes = up.where("_size > 1")
        largest = -(-largest // arity)
    return levels, done


def paths(levels: list[DataFrame], arity: int) -> DataFrame:
    """The lowest level's rows with `_path`, the `_others` from their level to the root, handed down from parent to child.

    Every few levels the paths are written, which keeps plans short; the lowest ones, which are most of the rows, are not.
    """
    above = None
    for k, level in reversed(list(enumerate(levels))):
        own = F.array("_others")
        if above is None:
            above = level.withColumn("_path", own).drop("_others")
            continue
        parent = above.select(F.col("_tree").alias("_t"), F.col("_at").alias("_s"), F.col("_path").alias("_up"))
        child = level.withColumn("_parent", F.expr(f"_at div {arity}"))
        child = child.join(parent, (F.col("_tree") == F.col("_t")) & (F.col("_parent") == F.col("_s")), "left").drop("_t", "_s", "_parent")
        above = child.withColumn("_path", F.when(F.col("_up").isNull(), own).otherwise(F.concat(own, F.col("_up")))).drop("_up", "_others")
        if k and k % PLANNED == 0:
            above = materialize(above, "manifest-paths")
    return above


def fold(start: Column, at: Column, path: Column, arity: int) -> Column:
    """The digest (hex) that a node (hex) at place `at` leads to with its path of siblings."""

    def step(acc: Column, others: Column) -> Column:
        slot = F.pmod(acc.at, F.lit(arity)).cast("int")
        left = F.substring(others, F.lit(1), slot * 32)
        right = F.substring(others, slot * 32 + 1, F.length(others))
        node = F.sha2(F.concat(hexed(left), acc.node, hexed(right)).cast("binary"), 256)
        return F.struct(node.alias("node"), F.floor(acc.at / arity).cast("long").alias("at"))

    return F.aggregate(path, F.struct(start.alias("node"), at.cast("long").alias("at")), step).node


def joined(path: Column) -> Column:
    return F.aggregate(path, empty(), lambda a, b: F.concat(a, b))


def tree(leaves: DataFrame, arity: int) -> tuple[DataFrame, DataFrame]:
    """(leaves with `_path`, roots (_tree, _digest)) of leaves (_tree, _at, _digest, _size, ...)."""
    levels, roots = build(leaves, arity)
    lone = leaves.where("_size = 1").withColumn("_path", F.array().cast("array<binary>"))
    return (lone.unionByName(paths(levels, arity)) if levels else lone), roots


def manifest(
    docs: DataFrame, fields: Sequence[str] = FIELDS, key: str = "doc_id", group: str = "lang", arity: int = 2, forged: dict[str, Column] | None = None
) -> DataFrame:
    """One row per row of `docs`: key, group, place, leaf, forged, subroot, root, proof, place_of_group, group_proof, forged_root.

    A leaf is the digest of the row's `fields`, each with its length. Leaves of a group are ordered
    by `key` (nulls first; ties by leaf, so that only equal rows share a place's order), and every
    `arity` consecutive nodes become their digest until one is left, the subroot; subroots ordered
    by `group` (nulls first, bytewise) give the root in the same way. A run may be shorter at the
    end, and a single node there is hashed alone. `proof` and `group_proof` are the other digests of
    the runs on the way up (32 bytes each, left to right, one entry per level). `forged` replaces
    fields by expressions over `docs`; `forged` (the column) is the leaf that these values give, and
    `forged_root` what it leads to with the untouched proofs: the root exactly if nothing was changed.

    Null fields count as null, not as empty; repeated rows are leaves of their own; an empty table
    gives an empty result; texts of any length count whole; other columns are not read. Groups of
    any size are spread over tasks by place.
    """
    changed = {f: (forged or {}).get(f, F.col(f)) for f in fields}
    leaves = docs.select(
        F.col(key).alias("_key"), F.col(group).alias("_group"),
        digest(leaf_text([F.col(f) for f in fields])).alias("_digest"),
        (digest(leaf_text([changed[f] for f in fields])) if forged else F.lit(None).cast("binary")).alias("_forged"),
    )
    leaves = materialize(leaves.withColumn("_row", F.monotonically_increasing_id()), "leaves")
    sizes = materialize(leaves.groupBy("_group").agg(F.count(F.lit(1)).alias("_size")), "groups")
    groups = materialize(positions(sizes, [], ["_group"]).select(F.col("_group").alias("_g"), "_size", F.col("_at").alias("_tree")), "groups")
    placed = positions(leaves, ["_group"], ["_key", "_digest", "_row"]).join(groups, F.col("_group").eqNullSafe(F.col("_g"))).drop("_g", "_row")
    placed = materialize(placed, "placed")
    own, subroots = tree(placed, arity)
    n = groups.count()
    tops = subroots.select(F.lit(0).alias("_tree"), F.col("_tree").alias("_at"), "_digest", F.lit(n).cast("long").alias("_size"))
    tops = materialize(tops, "subroots")
    top, root = tree(tops, arity)
    top = materialize(top.select(F.col("_at").alias("_t"), F.col("_digest").alias("_subroot"), F.col("_path").alias("_over")), "group-proofs")
    out = own.join(top, F.col("_tree") == F.col("_t")).crossJoin(F.broadcast(root.select(F.col("_digest").alias("_root"))))  # one row
    ends = fold(fold(hexed(F.coalesce("_forged", "_digest")), F.col("_at"), F.col("_path"), arity), F.col("_tree"), F.col("_over"), arity)
    return out.select(
        F.col("_key").alias("key"), F.col("_group").alias("group"), F.col("_at").alias("place"), hexed(F.col("_digest")).alias("leaf"),
        hexed(F.col("_forged")).alias("forged"), hexed(F.col("_subroot")).alias("subroot"), hexed(F.col("_root")).alias("root"),
        F.col("_path").alias("proof"), F.col("_tree").alias("place_of_group"), F.col("_over").alias("group_proof"), ends.alias("forged_root"),
    )


def tampered_chars() -> Column:
    """`n_chars`, one more where 7 divides the checksum of the id."""
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    return F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))


def checked(docs: DataFrame) -> DataFrame:
    """The manifest of documents, and whether each row still leads to the root after the tampering."""
    m = manifest(docs, forged={"n_chars": tampered_chars()})
    return m.select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root",
        F.sha2(hexed(F.concat(joined(F.col("proof")), joined(F.col("group_proof")))).cast("binary"), 256).alias("proof_sha256"),
        F.col("forged_root").alias("folded_root"), (F.col("forged_root") == F.col("root")).alias("verified"),
    )


def sql() -> str:
    """The same rows in DuckDB: levels and folds as recursive queries."""

    def leaf(chars: str) -> str:
        parts = [f"coalesce(strlen(cast({f} as varchar)) || ':' || cast({f} as varchar), '-')" for f in ("doc_id", "source", "lang", chars, "text")]
        return f"sha256({' || '.join(parts)})"

    bit = "case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end"
    return f"""
    with recursive crc(doc_id, s, i, c) as (
        select distinct doc_id, cast(doc_id as varchar), 0, cast(4294967295 as bigint) from documents where doc_id is not null
        union all
        select doc_id, s, i + 1, {bit} from (
            select doc_id, s, i, case when i % 8 = 0 then xor(c, cast(ascii(substr(s, i // 8 + 1, 1)) as bigint)) else c end as c
            from crc where i < 8 * length(s))),
    hit as materialized (select doc_id, xor(c, 4294967295) % 7 = 0 as hit from crc where i = 8 * length(s)),
    d as materialized (
        select doc_id, lang, {leaf("n_chars")} as leaf, {leaf("n_chars + 1")} as forged_leaf, coalesce(hit, false) as hit
        from documents left join hit using (doc_id)),
    langs as materialized (select lang, row_number() over (order by lang nulls first) - 1 as t, n from (select lang, count(*) as n from d group by lang)),
    leaves as materialized (
        select doc_id, leaf, case when hit then forged_leaf else leaf end as forged, t, n,
               row_number() over (partition by t order by doc_id nulls first, leaf) - 1 as pos
        from d join langs l on d.lang is not distinct from l.lang),
    sub(level, t, pos, digest, n) as (
        select 0, t, pos, leaf, n from leaves
        union all
        select level + 1, t, pos // 2, sha256(string_agg(digest, '' order by pos)), max((n + 1) // 2)
        from sub where n > 1 group by level, t, pos // 2),
    subroots as materialized (select t, digest from sub where n = 1),
    top(level, pos, digest, n) as (
        select 0, t, digest, (select count(*) from langs) from subroots
        union all
        select level + 1, pos // 2, sha256(string_agg(digest, '' order by pos)), max((n + 1) // 2) from top where n > 1 group by level, pos // 2),
    nodes as materialized (select level, t, pos, digest, n from sub where n > 1),
    tops as materialized (select level, pos, digest, n from top where n > 1),
    low(doc_id, t, pos0, forged, level, pos, node, proof, last) as (
        select doc_id, t, pos, forged, 0, pos, forged, '', n <= 1 from leaves
        union all
        select doc_id, l.t, pos0, forged, l.level + 1, l.pos // 2,
               sha256(case when l.pos % 2 = 0 then node || coalesce(s.digest, '') else coalesce(s.digest, '') || node end),
               proof || coalesce(s.digest, ''), z.n <= 2
        from low l join (select distinct level, t, n from nodes) z on z.level = l.level and z.t = l.t
        left join nodes s on s.level = l.level and s.t = l.t and s.pos = xor(l.pos, 1)
        where not last),
    high(doc_id, t, pos0, level, pos, node, proof, last) as (
        select doc_id, t, pos0, 0, t, node, proof, (select count(*) from langs) <= 1 from low where last
        union all
        select doc_id, t, pos0, h.level + 1, h.pos // 2,
               sha256(case when h.pos % 2 = 0 then node || coalesce(s.digest, '') else coalesce(s.digest, '') || node end),
               proof || coalesce(s.digest, ''), z.n <= 2
        from high h join (select distinct level, n from tops) z on z.level = h.level
        left join tops s on s.level = h.level and s.pos = xor(h.pos, 1)
        where not last)
    select l.doc_id, l.leaf, r.digest as subroot, root.digest as root, sha256(h.proof) as proof_sha256,
           h.node as folded_root, h.node = root.digest as verified
    from leaves l join high h on h.t = l.t and h.pos0 = l.pos and h.last join subroots r on r.t = l.t
    cross join (select digest from top where n = 1) root"""
