"""Substring dedup against a plain dictionary of windows."""

import hashlib
import re

from barloom.llm.substring_dedup import dedup_substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, width=20):
    seen, out = {}, {}
    words = {d: WORD.findall(t or "") for d, t in docs}
    for d in sorted(words):
        for s in range(len(words[d]) - width + 1):
            seen.setdefault(tuple(words[d][s : s + width]), (d, s))
    for d, w in words.items():
        gone = set()
        for s in range(len(w) - width + 1):
            if seen[tuple(w[s : s + width])] < (d, s):
                gone.update(range(s, s + width))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[d] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def texts():
    import random

    r = random.Random(5)
    vocab = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(60)]
    passage = [r.choice(vocab) for _ in range(55)]
    docs = [(0, None), (1, ""), (2, " ".join(passage))]
    for d in range(3, 60):
        w = [r.choice(vocab) for _ in range(r.randrange(0, 120))]
        for _ in range(r.randrange(0, 4)):
            a = r.randrange(0, 35)
            at = r.randrange(0, len(w) + 1)
            w[at:at] = passage[a : a + r.randrange(15, 55)]
        if d % 9 == 0:
            w = ["same"] * 70
        docs.append((d, r.choice([" ", "\t", "\n ", "  "]).join(w)))
    docs.append((60, docs[20][1]))
    docs.append((61, " ".join(passage * 40)))
    return docs


def test_brute_force(spark):
    docs = texts()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    df = df.selectExpr("*", "1 as h", "'x' as start", "2 as doc")
    rows = dedup_substrings(df).collect()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows}
    want = brute(docs)
    assert len(rows) == len(docs)
    assert got == want
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in rows)


def test_odd_rows(spark):
    w = " ".join(f"a{i}" for i in range(30))
    df = spark.createDataFrame([(None, w), (None, w), (1, w), (1, w), (2, w)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.n_removed) for r in dedup_substrings(df).collect())
    assert got == [(0, 0), (0, 0), (1, 0), (1, 0), (2, 30)]
    assert dedup_substrings(df.where("false")).count() == 0
