"""N-gram Jaccard join by chosen paths, with exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import blocks as B
from barloom.llm import text as T
from barloom.llm.components import components
from barloom.session import materialize

POSITIONS = 64  # sampled tokens per set: minima under so many hash functions
LIMIT = 64  # buckets up to this size are compared at once; a level makes large buckets so many times smaller, about
FIRST_RUNS = 2  # runs after whose links the others look for what is not yet connected
CHUNK = 2048  # sets of a chunk of a large bucket or group
MULTIPLIERS = T.mix(np.arange(1, POSITIONS + 1, dtype=np.uint64)) | np.uint64(1)


def sets(s: T.Slice, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, shingle hash) of a slice, ordered by row and hash."""
    rows, hashes, _ = T.shingles(s, width)
    return T.unique_pairs(rows, hashes)


def signatures(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """(n, POSITIONS) minima of a set's hashes, 32 bits each; rows without a set hold zeros."""
    out = np.zeros((n, POSITIONS), np.uint32)
    present, first = np.unique(rows, return_index=True)
    if len(present):
        for k, m in enumerate(MULTIPLIERS):
            out[present, k] = np.minimum.reduceat(hashes * m, first) >> np.uint64(32)
    return out


def depth_for(n: int) -> int:
    """Levels until buckets of n sets that share nothing but chance are small: grows with the logarithm of n."""
    return 1 + max(1, int(np.ceil(log(max(n / LIMIT, 1.0)) / log(LIMIT))))


def runs_for(recall: float, depth: int) -> int:
    """Runs after which a pair at the threshold shares a last-level node with the probability asked for.

    With tokens sampled at 1 / (threshold * positions), such a pair shares one child of a shared
    node on average, Poisson distributed; `alive` is the chance that its line of nodes lasts.
    """
    alive = 1.0
    for _ in range(depth):
        alive = 1 - exp(-alive)
    return max(1, int(np.ceil(log(1 - recall) / log(1 - alive))))


def child(node: np.ndarray, position: np.ndarray, token: np.ndarray) -> np.ndarray:
    return T.mix(T.mix(node + T.mix(position.astype(np.uint64))) + token.astype(np.uint64))


def chosen(node: np.ndarray, threshold: float) -> np.ndarray:
    """(nodes, POSITIONS) mask of the positions that each node samples; the same for all its members."""
    u = T.mix(node[:, None] * T.P2 + MULTIPLIERS[None, :])
    return u < np.uint64(2**64 / (threshold * POSITIONS))


def describe(docs: DataFrame, width: int) -> DataFrame:
    """(_id, _n, _a, _b, _sig): size, 128-bit digest and signature of each text's set; no row without an id."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in T.slices(b.column(1)):
                n = s.last - s.first
                rows, hashes = sets(s, width)
                size = np.bincount(rows, minlength=n)
                a, c = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                np.add.at(a, rows, T.mix(hashes ^ T.P1))
                np.add.at(c, rows, T.mix(hashes ^ T.P2))
                sig = signatures(rows, hashes, n)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(s.first, n), pa.array(size), pa.array(T.signed(a)), pa.array(T.signed(c)),
                     pa.array([x.tobytes() for x in sig], pa.binary())],
                    ["_id", "_n", "_a", "_b", "_sig"],
                )

    known = docs.select("_id", "_text").where("_id is not null")
    return materialize(known.mapInArrow(make, "_id long, _n long, _a long, _b long, _sig binary"), "signatures")


def _sig(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), POSITIONS)


def buckets(reps: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(node, _first, _rep) rows of the buckets to compare; `_first` marks those of the first runs.

    Level by level: every set goes to the children of its node that belong to the tokens the node
    samples and the set holds. Nodes with one set end, nodes with up to LIMIT sets are buckets, and
    only larger ones are split again; what is still large at the last level is a bucket, too.
    """
    deepest = depth_for(reps.count())
    roots = T.mix(np.arange(1, runs_for(recall, deepest) + 1, dtype=np.uint64))
    run, position = np.nonzero(chosen(roots, threshold))
    schema = "node long, _first boolean, _rep long"

    def rows(node: np.ndarray, first: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(T.signed(node)), pa.array(first), pa.array(rep)], ["node", "_first", "_rep"])

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig, rep = _sig(b.column(1)), b.column(0).to_numpy()
            for lo in range(0, len(rep), 4096):
                part = sig[lo : lo + 4096]
                node = child(np.tile(roots[run], len(part)), np.tile(position, len(part)), part[:, position].ravel())
                yield rows(node, np.tile(run < FIRST_RUNS, len(part)), np.repeat(rep[lo : lo + 4096], len(run)))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, rep, sig = b.column(0).to_numpy().view(np.uint64), b.column(2).to_numpy(), _sig(b.column(3))
            first = b.column(1).to_numpy(zero_copy_only=False)
            for lo in range(0, len(rep), 4096):
                at, position = np.nonzero(chosen(node[lo : lo + 4096], threshold))
                at += lo
                yield rows(child(node[at], position, sig[at, position]), first[at], rep[at])

    level = materialize(reps.select("_rep", "_sig").mapInArrow(start, schema), "paths")
    out = None
    for depth in range(1, deepest + 1):
        size = level.groupBy("node").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1")
        sized = materialize(level.join(size, "node"), "nodes")
        leaf = sized if depth == deepest else sized.where(F.col("_k") <= LIMIT)
        out = leaf if out is None else out.union(leaf)
        large = sized.where(F.col("_k") > LIMIT).drop("_k")
        if depth == deepest or large.isEmpty():
            break
        deeper = large.join(reps.select("_rep", "_sig"), "_rep").select("node", "_first", "_rep", "_sig")
        level = materialize(deeper.mapInArrow(split, schema), "paths")
    return out.select("node", "_first", "_rep")


def joins(met: DataFrame, bar: float) -> DataFrame:
    """Edges (a, b) between labels whose sets' signatures agree well enough, found in blocks of (node, _i, _j, _c, label, _sig).

    Pairs that links found before connect already are not looked at, so a task returns no more
    edges than labels it joins, however many pairs there are.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in B.runs(batches, ["node", "_i", "_j"]):
            i, j, c, label = (t[k].to_numpy() for k in ("_i", "_j", "_c", "label"))
            sig = _sig(t["_sig"])
            labels, own = np.unique(label, return_inverse=True)
            root = np.arange(len(labels))
            for a, b in B.pairs(group, i, j, c):
                apart = root[own[a]] != root[own[b]]
                a, b = a[apart], b[apart]
                near = (sig[a] == sig[b]).mean(1) >= bar
                if near.any():
                    root = B.roots(len(labels), root[own[a[near]]], root[own[b[near]]])[root]
            k = np.flatnonzero(root != np.arange(len(labels)))
            yield pa.RecordBatch.from_arrays([pa.array(labels[k]), pa.array(labels[root[k]])], ["a", "b"])

    blocks = B.together(met.select("node", "_i", "_j", "_c", "label", "_sig"), ["node"])
    return blocks.mapInArrow(compare, "a long, b long")


def candidates(reps: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(id, component): groups of sets that signatures connect, over all buckets of all runs.

    The bar lies four standard errors of a signature under the threshold. Chunks of the first runs'
    buckets come first, each compared within itself; their groups are then labels with which all
    buckets are compared whole, all chunks with each other, so that only what joins two groups is
    written: rows grow with the number of sets, not with its square.
    """
    bar = threshold - 4 * sqrt(threshold * (1 - threshold) / POSITIONS)
    dealt = materialize(B.chunked(buckets(reps, threshold, recall), ["node"], "_rep", CHUNK), "buckets")
    first = dealt.where("_first").join(reps.select("_rep", "_sig"), "_rep")
    first = first.withColumns({"_i": F.col("_c"), "_j": F.col("_c"), "label": F.col("_rep")})
    early = materialize(joins(first, bar).distinct(), "joins")
    near = components(early)
    labelled = reps.select("_rep", "_sig").join(near, F.col("_rep") == F.col("id"), "left")
    labelled = materialize(labelled.select("_rep", F.coalesce("component", "_rep").alias("label"), "_sig"), "labels")
    late = joins(B.paired(dealt.drop("_first")).join(labelled, "_rep"), bar)
    return components(early.union(late))


def overlaps(hashes: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets `left` with the sets `right`, by products of slices of the incidence matrix."""
    n = len(hashes)
    owner = np.repeat(np.arange(n), [len(h) for h in hashes])
    _, token, count = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    shared = count[token] > 1
    owner, token = owner[shared], np.cumsum(count > 1)[token[shared]] - 1
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    out, wide = np.zeros((len(left), len(right)), np.float32), max(256, (1 << 21) // n)
    for lo in range(0, int(token[-1]) + 1 if len(token) else 0, wide):
        a, b = np.searchsorted(token, [lo, lo + wide])
        m = np.zeros((n, wide), np.float32)
        m[owner[a:b], token[a:b] - lo] = 1
        out += m[left] @ m[right].T
    return out.astype(float)


def verify(members: DataFrame, docs: DataFrame, threshold: float, width: int) -> DataFrame:
    """(_rep, links, peer): exact links of each set within its candidate component, and a spanning forest of them."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in T.slices(b.column(3)):
                rows, hashes = sets(s, width)
                cut = np.searchsorted(rows, np.arange(s.last - s.first + 1))
                blob = [hashes[cut[k] : cut[k + 1]].tobytes() for k in range(len(cut) - 1)]
                part = b.slice(s.first, s.last - s.first)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(blob, pa.binary())], ["_g", "_rep", "_copies", "_set"])

    full = members.join(docs, members["_rep"] == docs["_id"]).select("_g", "_rep", "_copies", "_text")
    full = full.dropDuplicates(["_rep"])
    full = materialize(full.mapInArrow(spell, "_g long, _rep long, _copies long, _set binary"), "sets")
    met = B.paired(B.chunked(full.withColumn("_bytes", F.length("_set")), ["_g"], "_rep", CHUNK, weight="_bytes"))
    met = B.together(met.select("_g", "_i", "_j", "_c", "_rep", "_copies", "_set"), ["_g"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in B.runs(batches, ["_g", "_i", "_j"]):
            i, j, c, rep, copies = (t[k].to_numpy() for k in ("_i", "_j", "_c", "_rep", "_copies"))
            raw = t["_set"]
            cut = np.searchsorted(group, np.arange(int(group[-1]) + 2))
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                own = [np.frombuffer(raw[k].as_py(), np.uint64) for k in range(lo, hi)]
                size = np.array([len(h) for h in own])
                one = np.arange(hi - lo) if i[lo] == j[lo] else np.flatnonzero(c[lo:hi] == i[lo])
                two = one if i[lo] == j[lo] else np.flatnonzero(c[lo:hi] == j[lo])
                both = overlaps(own, one, two)
                link = both >= threshold * (size[one][:, None] + size[two] - both) - 1e-9
                if i[lo] == j[lo]:
                    np.fill_diagonal(link, False)
                a, b = np.nonzero(link)
                top = B.roots(hi - lo, one[a], two[b])
                n = np.zeros(hi - lo, np.int64)
                n[one] += link @ copies[lo:hi][two]
                if i[lo] != j[lo]:
                    n[two] += link.T @ copies[lo:hi][one]
                k = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(rep[lo + k]), pa.array(n[k]), pa.array(rep[lo + top[k]])], ["_rep", "links", "peer"])

    return materialize(met.mapInArrow(compare, "_rep long, links long, peer long"), "links")


def similarity_classes(
    docs: DataFrame, threshold: float = 0.8, width: int = 5, recall: float = 0.9999, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_shingles, n_links, class_id, kept) per input row.

    Two texts are linked if the Jaccard similarity of their sets of `width`-word shingles is
    `threshold` or more. Words are runs of bytes other than space and \\x09-\\x0D; a shorter text is
    one shingle of all its words. `n_links` counts the other texts linked directly, `class_id` is
    the least id that links reach, and the row with that id is `kept`.

    Texts with equal sets are joined once, by the least id, and counted by their number. Chosen
    paths (see `buckets`) bring similar sets together; signatures pick candidates, whose connected
    groups are then verified exactly in blocks, all pairs of a group, so no link between texts of a
    group is lost and no pair is written. `recall` is the chance to bring a single pair at the
    threshold together; it is higher above it, and for texts with several links.

    Null and empty texts and null ids link with nothing (a null id is its own class: null, kept).
    Repeated rows of an id count once as a text, by its least set digest; an empty table gives an
    empty result. Whole texts count. Other columns of the input are not read.
    """
    d = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    sig = describe(d, width)
    least = F.min_by(F.struct("_n", "_a", "_b", "_sig"), F.struct("_a", "_b")).alias("s")
    one = materialize(sig.where("_n > 0").groupBy("_id").agg(least).select("_id", "s.*"), "sets-by-id")
    reps = one.groupBy("_a", "_b").agg(F.min("_id").alias("_rep"), F.count(F.lit(1)).alias("_copies"), F.first("_sig").alias("_sig"))
    reps = materialize(reps, "sets")
    near = candidates(reps, threshold, recall)
    members = near.join(reps.select("_rep", "_copies"), F.col("id") == F.col("_rep")).select(F.col("component").alias("_g"), "_rep", "_copies")
    found = verify(members, d, threshold, width)
    links = found.groupBy("_rep").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("_rep").alias("a"), F.col("peer").alias("b")))
    known = reps.join(links, "_rep", "left").join(comp, F.col("_rep") == F.col("id"), "left")
    known = known.select("_a", "_b", (F.coalesce("links", F.lit(0)) + F.col("_copies") - 1).alias("n_links"), F.coalesce("component", "_rep").alias("class_id"))
    named = one.select("_id", "_n", "_a", "_b").join(known, ["_a", "_b"]).select(F.col("_id").alias("_key"), "_n", "n_links", "class_id")
    out = d.select("_id").join(named, F.col("_id") == F.col("_key"), "left")
    group = F.coalesce("class_id", "_id")
    return out.select(
        F.col("_id").alias(id_col), F.coalesce("_n", F.lit(0)).cast("long").alias("n_shingles"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), group.alias("class_id"),
        F.coalesce(group == F.col("_id"), F.lit(True)).alias("kept"),
    )


def sql(threshold: float = 0.8) -> str:
    """The same rows in DuckDB, by joining all shared shingles."""
    return f"""
    with recursive w as materialized (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
    sh as materialized (
        select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s
        from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from w where len(w) > 0)),
    n as materialized (select doc_id, count(*) as n from sh group by 1),
    pairs as materialized (
        select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as c from sh x join sh y on x.s = y.s and x.doc_id <> y.doc_id group by 1, 2)
        join n na on na.doc_id = a join n nb on nb.doc_id = b where c >= {threshold} * (na.n + nb.n - c) - 1e-9),
    reach as (select a, b from pairs union select r.a, p.b from reach r join pairs p on r.b = p.a),
    least as (select a, least(a, min(b)) as class_id from reach group by a)
    select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(k.n_links, 0) as n_links,
           coalesce(l.class_id, d.doc_id) as class_id, coalesce(l.class_id, d.doc_id) = d.doc_id as kept
    from documents d left join n on n.doc_id = d.doc_id left join least l on l.a = d.doc_id
    left join (select a, count(*) as n_links from pairs group by a) k on k.a = d.doc_id"""
