"""Merkle manifest against plain Python, and with runs of other lengths."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from barloom.llm import manifest


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes, arity):
    """(root, siblings of each node level by level, with slots)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(paths):
            first = at[k] // arity * arity
            run = nodes[first : first + arity]
            p.append((at[k] - first, run[: at[k] - first] + run[at[k] - first + 1 :]))
        nodes = [h("".join(nodes[i : i + arity])) for i in range(0, len(nodes), arity)]
        at = [x // arity for x in at]
    return nodes[0], paths


def brute(rows, arity=2):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of (doc_id, source, lang, n_chars, text) rows."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in langs]
    done = [climb([leaf(r) for r in g], arity) for g in groups]
    root, tops = climb([d[0] for d in done], arity)
    out = []
    for g, (subroot, paths), top in zip(groups, done, tops, strict=True):
        for r, path in zip(g, paths, strict=True):
            hit = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = leaf((*r[:3], r[3] + 1, r[4])) if hit else leaf(r)
            for slot, others in [*path, *top]:
                node = h("".join(others[:slot] + [node] + others[slot:]))
            proof = h("".join(x for _, others in [*path, *top] for x in others))
            out.append((r[0], leaf(r), subroot, root, proof, node, node == root))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, _digest int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)


def some(n):
    langs = [None, "", "de", "en", "en", "en", "fr", "ünï"]
    return [(k * 3 % 211, f"s{k % 3}" if k % 5 else None, langs[k % 8], None if k % 11 == 0 else k, None if k % 13 == 0 else f"té{k}") for k in range(n)]


def test_brute_force(spark):
    rows = some(150) + [(None, "a", "en", 1, "no id"), (None, "a", "en", 1, "no id"), (7, "a", "en", 2, "same id"), (7, "a", "en", 2, "same id")]
    rows += [(9000, "a", "it", 3, "alone"), (9001, "a", "pt", 300000, "long " * 60000), (9002, "", "en", 0, "")]
    got = [tuple(r) for r in manifest.checked(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_small(spark, n):
    rows = [(k, "s", "en", 5, "t") for k in range(n)]
    assert sorted(map(tuple, manifest.checked(frame(spark, rows)).collect())) == (sorted(brute(rows)) if n else [])


@pytest.mark.parametrize("arity", [3, 4])
def test_other_runs(spark, arity):
    rows = some(60)
    m = manifest.manifest(frame(spark, rows), arity=arity, forged={"n_chars": manifest.tampered_chars()})
    got = {(r.key, r.leaf, r.subroot, r.root, r.forged_root) for r in m.collect()}
    assert got == {(i, x, s, root, node) for i, x, s, root, _, node, _ in brute(rows, arity)}


def test_untouched_rows_lead_to_the_root(spark):
    m = manifest.manifest(frame(spark, some(40)))
    assert m.where(F.col("forged_root") != F.col("root")).count() == 0 and m.where("forged is not null").count() == 0
