"""N-gram join against all pairs."""

import random
import re

from barloom.llm import ngram_join as J

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, threshold=0.8):
    sets = {}
    for d, t in docs:
        w = WORD.findall(t or "")
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    links = {d: {e for e in sets if e != d and sets[d] and len(sets[d] & sets[e]) >= threshold * len(sets[d] | sets[e]) - 1e-9} for d in sets}
    label = {d: d for d in sets}
    while True:
        new = {d: min([label[d], *(label[e] for e in links[d])]) for d in sets}
        if new == label:
            return {d: (len(sets[d]), len(links[d]), label[d]) for d in sets}
        label = new


def corpus():
    r = random.Random(11)
    vocab = [f"v{k}" for k in range(400)]
    base = [[r.choice(vocab) for _ in range(r.randrange(8, 160))] for _ in range(60)]
    docs = []
    for k, w in enumerate(base):
        docs.append(w)
        for _ in range(r.randrange(0, 4)):
            v = list(w)
            for _ in range(r.randrange(0, 1 + len(v) // 50)):
                v[r.randrange(len(v))] = r.choice(vocab)
            docs.append(v)
    hot = [r.choice(vocab) for _ in range(120)]
    for k in range(150):  # a large group of near copies
        v = list(hot)
        v[k % 110] = f"edit{k}"
        docs.append(v)
    docs += [hot] * 20 + [["only", "three", "words"]] * 3 + [["one"]]
    return [(k, " ".join(v)) for k, v in enumerate(docs)] + [(1000, None), (1001, ""), (1002, " \n ")]


def test_brute_force(spark, monkeypatch):
    monkeypatch.setattr(J, "CHUNK", 40)  # several chunks in a group
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as node", "2 as _rep").repartition(4)
    rows = J.similarity_classes(df).collect()
    assert len(rows) == len(docs)
    assert {r.doc_id: (r.n_shingles, r.n_links, r.class_id) for r in rows} == brute(docs)
    assert all(r.kept == (r.class_id == r.doc_id) for r in rows)


def test_odd_rows(spark):
    t = "a b c d e f g h"
    df = spark.createDataFrame([(1, t), (1, t), (2, t), (None, t), (3, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_links, r.class_id or 0, r.kept) for r in J.similarity_classes(df).collect())
    assert got == [(0, 0, 0, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
    assert J.similarity_classes(df.where("false")).count() == 0


def test_rows_grow_with_the_group(spark, monkeypatch):
    """A group of near copies makes candidate edges in proportion to its size, in chunks that are many or few."""
    monkeypatch.setattr(J, "CHUNK", 100)
    made, plain = [], J.components
    monkeypatch.setattr(J, "components", lambda e: made.append(e.count()) or plain(e))
    for n in (200, 800):
        made.clear()
        r = random.Random(n)
        hot = [f"w{r.randrange(5000)}" for _ in range(150)]
        docs = [(k, " ".join([*hot[: k % 140], f"edit{k}", *hot[k % 140 + 1 :]])) for k in range(n)]
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
        rows = J.similarity_classes(df).collect()
        assert {(x.class_id, x.n_links) for x in rows} == {(0, n - 1)}
        assert max(made[:2]) <= 2 * n, made


def test_long_texts_and_ties(spark):
    """Very long texts are whole sets; a pair exactly at the threshold is linked."""
    long = [f"w{k}" for k in range(60000)]
    docs = [(1, " ".join(long)), (2, " ".join(long[:59000] + ["x"])), (3, " ".join(long[:40000]))]
    nine = [f"s{k}" for k in range(13)]  # 9 shingles; with the last word gone 8 of 9, with five words more 9 of 14
    docs += [(4, " ".join(nine)), (5, " ".join(nine[:-1])), (6, " ".join(nine + list("abcde")))]
    edge = [f"t{k}" for k in range(12)]  # 8 shingles against 10: exactly 0.8
    docs += [(7, " ".join(edge)), (8, " ".join([*edge, "y", "z"]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.n_links, r.class_id) for r in J.similarity_classes(df).collect()}
    assert got == brute(docs) and got[8] == (10, 1, 7)
