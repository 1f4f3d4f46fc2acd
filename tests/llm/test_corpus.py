"""Line dedup, quality classifier, mixture and the pipeline against plain Python."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from barloom.llm import decontaminate, line_dedup, mixing, ngram_join, quality
from barloom.session import materialize
from tests.llm.test_ngram_join import brute as brute_join

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BLANK = " \t\x0b\x0c\r"


def plain_lines(docs, min_sites):
    sites = collections.defaultdict(set)
    for _, text, site in docs:
        for line in (text or "").split("\n"):
            if site is not None:
                sites[line.strip(BLANK)].add(site)
    gone = {k for k, v in sites.items() if k and len(v) >= min_sites}
    out = []
    for d, text, _ in docs:
        lines = [] if text is None else text.split("\n")
        kept = [x for x in lines if x.strip(BLANK) not in gone]
        out.append((d, None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def line_docs():
    r = random.Random(1)
    shared = {f"line on {n} sites": n for n in range(1, 16)}
    docs = []
    for d in range(200):
        site = f"s{d % 16}"
        lines = [f"own {d} {k}" for k in range(r.randrange(0, 4))]
        lines += [f"{r.choice(['', ' ', chr(9)])}{x}{r.choice(['', '  '])}" for x, n in shared.items() if d % 16 < n and d < 60 + n]
        r.shuffle(lines)
        docs.append((d, "\n".join(lines), site))
    return [*docs, (300, None, "s1"), (301, "", "s1"), (302, "\n \n", "s2"), (303, "line on 15 sites", None), (None, "line on 14 sites\nx", "s0"), (0, docs[0][1], "s0")]


def test_lines(spark):
    docs = line_docs()
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 as k", "2 as x").repartition(4)
    for sites in (2, 8):
        rows = line_dedup.dedup_lines(df, sites, carry=("source", "k")).collect()
        got = [(r.doc_id, r.text, r.n_lines, r.n_removed) for r in rows]
        key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
        assert sorted(got, key=key) == sorted(plain_lines(docs, sites), key=key)
    assert line_dedup.dedup_lines(df.where("false")).count() == 0


def rated_corpus(n=400):
    r = random.Random(9)
    words = [f"word{k}" for k in range(200)]
    rows = []
    for d in range(n):
        w = [r.choice(words) for _ in range(r.randrange(20, 120))]
        g = d % 3
        if g == 0:
            w = [x + "%%%" for x in w]
        if g == 1:
            w[len(w) // 2] = r.choice(["awful", "horrid"])
        rows.append((d, " ".join(w), g))
    return rows


def test_quality_held_out(spark):
    rows = rated_corpus()
    df = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string").selectExpr("*", "1 as grade").repartition(3)
    rated = spark.createDataFrame([(d, g) for d, _, g in rows if d < 300] + [(None, 1), (3, None), (4, 9)], "doc_id long, grade int")
    got = {r.doc_id: r for r in quality.classify(df, rated).collect()}
    test = [(got[d], g) for d, _, g in rows if d >= 300]
    assert np.mean([r.grade == g for r, g in test]) > 0.95
    assert np.mean([r.kept == (g == 2) for r, g in test]) > 0.95
    assert all(0 <= r.expected_grade <= 2 and r.kept == (r.tail_prob >= 0.5) for r in got.values())
    good = {r.doc_id for r in quality.select_good(df, rated).collect()}
    assert good == {d for d, r in got.items() if r.kept}


def test_quality_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "x y"), (3, "long " * 100_000), (3, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, grade int")
    assert quality.classify(df, none).count() == 5
    one = spark.createDataFrame([(3, 2)], "doc_id long, grade int")
    assert quality.classify(df, one).count() == 5
    assert quality.classify(df.where("false"), one).count() == 0


def test_ordinal_recovers_thresholds():
    """The fit against a brute-force likelihood on one binary feature."""
    r = np.random.default_rng(0)
    x = r.integers(0, 2, 3000)
    z = 2.0 * x + r.logistic(size=3000)
    grade = (z > 0.5).astype(int) + (z > 2.0)
    row = np.flatnonzero(x)
    m = quality.fit(row, np.zeros(len(row), np.int64), grade, 3, 4, l2=0.0)
    assert abs(m.weights[0] - 2) < 0.25 and np.abs(m.thresholds - [0.5, 2.0]).max() < 0.25
    def loss(w, t):
        up, lo = np.append(t, np.inf)[grade] - w * x, np.append(-np.inf, t)[grade] - w * x
        return -np.log(1 / (1 + np.exp(-up)) - 1 / (1 + np.exp(-lo))).mean()
    best = loss(m.weights[0], m.thresholds)
    for dw in (-0.1, 0.1):
        assert loss(m.weights[0] + dw, m.thresholds) > best - 1e-4
        assert loss(m.weights[0], m.thresholds + [dw, 0]) > best - 1e-4
        assert loss(m.weights[0], m.thresholds + [0, dw]) > best - 1e-4


def mix_docs(spark):
    r = random.Random(6)
    rows = []
    for d in range(600):
        text = " ".join(["w"] * r.randrange(1, 60)) + r.choice(["", "", " License", " a | b | c", " x@y"])
        rows.append((d, text, r.choice(["en", "en", "de", None]), r.choice(["a", "a", "a", "b", "c"])))
    rows += [(900, None, "en", "a"), (901, " ", "en", "a"), (None, "some words", "en", None)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as w", "2 as n", "3 as rate")


def test_mixture(spark):
    rows, df = mix_docs(spark)
    out = mixing.mix(df.repartition(3), sweeps=6, fraction=0.8).toPandas()
    assert (out["copies"] >= 1).all() and not {900, 901} & set(out["doc_id"].dropna())
    d = mixing.described(df).toPandas()
    assert d["n_tokens"].tolist() is not None and d["n_tokens"].sum() == sum(len((t or "").split()) for _, t, *_ in rows)
    # Plain raking over a dictionary of cells.
    cells = d[d.n_tokens > 0].groupby(list(mixing.DIMS))["n_tokens"].sum()
    w = cells.astype(float)
    powers = {"source": 0.5, "lang": 0.7, "topic": 0.5}
    for _ in range(6):
        for dim in mixing.DIMS:
            share = cells.groupby(dim).sum() ** powers[dim]
            w = w * (share / share.sum() / w.groupby(dim).sum()).reindex(w.index.get_level_values(dim)).to_numpy()
    rate = w / w.sum() * cells.sum() * 0.8 / cells
    for r in out.itertuples():
        assert abs(r.rate - rate[(r.source, r.lang, r.topic)]) < 1e-9
        assert r.copies in (int(r.rate), int(r.rate) + 1)
    # Expected tokens meet the marginals of the last dimension raked.
    got = (rate * cells).groupby("topic").sum()
    share = cells.groupby("topic").sum() ** 0.5
    assert np.allclose(got / got.sum(), share / share.sum())
    # The draw as a whole comes near its expectation.
    assert abs((out["copies"] * out["n_tokens"]).sum() / (0.8 * cells.sum()) - 1) < 0.1
    assert mixing.mix(df.where("false")).count() == 0


def test_mixture_targets(spark):
    _, df = mix_docs(spark)
    goal = spark.createDataFrame([("a", 0.2), ("b", 0.4), ("c", 0.4)], "source string, share double")
    out = mixing.mix(df.where("source is not null"), {"source": 1, "lang": 1.0, "topic": 1.0}, sweeps=20, targets={"source": goal})
    per = out.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("n")).toPandas().set_index("source")["n"]
    assert np.allclose((per / per.sum())[["a", "b", "c"]], [0.2, 0.4, 0.4], atol=0.05)


def test_mixture_of_odd_targets(spark):
    """A repeated value's shares add up, a null share is no target, a null value is the group of nulls."""
    _, df = mix_docs(spark)
    powers = {"source": 1, "lang": 1.0, "topic": 1.0}
    odd = spark.createDataFrame([("a", 0.1), ("a", 0.2), ("b", 0.3), (None, 0.4), ("c", None)], "source string, share double")
    plain = spark.createDataFrame([("a", 0.3), ("b", 0.3), (mixing.UNKNOWN, 0.4)], "source string, share double")
    drawn = lambda t: mixing.mix(df, powers, sweeps=4, targets={"source": t}).withColumn("rate", F.round("rate", 9))
    one, two = (sorted(map(tuple, drawn(t).collect()), key=str) for t in (odd, plain))
    assert one == two and {r[2] for r in one} >= {"a", "b", "c"}


def test_raking_stops_when_the_marginals_are_met(spark):
    _, df = mix_docs(spark)
    d = mixing.described(df)
    cells = d.groupBy(*mixing.DIMS).agg(F.sum("n_tokens").alias("n")).where("n > 0")
    goals = {dim: mixing.tempered(cells, dim, 0.5) for dim in mixing.DIMS}
    w = mixing.rake(cells, goals, 200)
    assert max(r.error for r in mixing.marginal_errors(w, goals).collect()) <= mixing.SETTLED


def test_mixture_of_long_texts(spark):
    df = spark.createDataFrame([(1, "w " * 300_000, "en", "a"), (2, "one two", "en", "b"), (2, "one two", "en", "b")], "doc_id long, text string, lang string, source string")
    out = mixing.mix(df, fraction=3.0).collect()
    assert {r.n_tokens for r in out} == {300_000, 2} and len(out) == 3


SF = "/root/testdata/sf0.01"


def test_pipeline_stages(spark):
    """Every stage on what the one before it kept, against plain Python."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for name, stage in P.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), "test-stage")
        assert tuple(docs.columns) == P.COLUMNS, name
        kept.append({r.doc_id: r for r in docs.collect()})
    start = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rated = quality.grade_of(F.col("quality"), F.col("toxic"))
    grade = {r.doc_id: r.g for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", rated.alias("g")).collect()}
    good, lines, single, clean = kept
    assert np.mean([(d in good) == (g == 2) for d, g in grade.items()]) > 0.97
    want = plain_lines([(d, r.text, r.source) for d, r in good.items()], 8)
    assert {d: r.text for d, r in lines.items()} == {d: t for d, t, *_ in want}
    assert all(r.n_chars == len(r.text) and r.lang == start[d].lang for d, r in lines.items())
    classes = brute_join([(d, r.text) for d, r in lines.items()])
    assert set(single) == {d for d, (_, _, c) in classes.items() if c == d}
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    items = [f" {plain(r.text)} " for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {d for d, r in single.items() if any(i in f" {plain(r.text)} " for i in items)}
    assert leaks and not leaks & set(clean) and len(single) - len(clean) <= len(leaks) + 5
    drawn = P.STAGES[-1][1](spark, docs, SF).collect()
    assert drawn and {r.doc_id for r in drawn} <= set(clean)
    assert ngram_join.LIMIT and decontaminate.SCHEMA


def test_pipeline_odd_rows(spark, tmp_path):
    """Nulls, blanks, repeats and columns of clashing names pass through every stage."""
    rows = [(1, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13), (2, None, None, None, None),
            (None, "x y z", "en", "s", 5), (3, "", "en", None, 0), (4, "word " * 50_000, "en", "s", 250_000)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as _id", "2 as k", "3 as _text")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in P.STAGES:
        assert stage(spark, docs, str(tmp_path)).collect() is not None
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0


def test_pipeline_keeps_one_row_of_copies(spark):
    """Repeated rows and copies without an id are copies; a leak goes whatever its id."""
    t = " ".join(f"w{k}" for k in range(40))
    lone = " ".join(f"v{k}" for k in range(40))
    rows = [(5, t), (5, t), (9, t + " x"), (None, t), (None, lone), (None, lone), (1, "else"), (2, None), (2, None), (3, "")]
    docs = spark.createDataFrame([(i, x, "en", "s", 1) for i, x in rows], DOCS)
    got = sorted(((r.doc_id or 0, r.text or "") for r in P.one_of_each(spark, docs, "").collect()))
    assert got == sorted([(5, t), (0, lone), (1, "else"), (2, ""), (2, ""), (3, "")])


def test_pipeline_drops_leaks_without_id(spark, tmp_path):
    item = " ".join(f"w{k}" for k in range(20))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"before {item} after"), (4, f"before {item} after"), (4, "clean"), (None, "clean too"), (None, None), (7, "")]
    docs = spark.createDataFrame([(i, x, "en", "s", 1) for i, x in rows], DOCS)
    got = sorted((r.doc_id or 0, r.text or "") for r in P.no_leaks(spark, docs, str(tmp_path)).collect())
    assert got == [(0, ""), (0, "clean too"), (4, "clean"), (7, "")]
