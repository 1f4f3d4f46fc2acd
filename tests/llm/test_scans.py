"""Decontamination, license scan, token counts and URL filter against plain Python."""

import random
import re

import numpy as np
import pytest

from barloom.llm import align, decontaminate, license_scan, token_counts, url_filter


def plain_alignment(a, b):
    best, h = 0, np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if x == y else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
            best = max(best, h[i, j])
    return best


def test_alignment():
    r = np.random.default_rng(4)
    a = r.integers(1, 6, (40, 12)).astype(np.uint64)
    b = r.integers(1, 6, (40, 20)).astype(np.uint64)
    al, bl = r.integers(1, 13, 40), r.integers(1, 21, 40)
    got = align.smith_waterman(a, b, al, bl)
    for k in range(40):
        assert got.score[k] == plain_alignment(a[k, : al[k]], b[k, : bl[k]])
        span = a[k, got.a_start[k] : got.a_end[k]], b[k, got.b_start[k] : got.b_end[k]]
        assert got.score[k] == plain_alignment(*span) and got.matches[k] <= min(map(len, span))


def contaminated_corpus():
    r = random.Random(2)
    vocab = [f"q{k}" for k in range(300)] + ["the", "of", "and"] * 30
    items = [(k, " ".join(r.choice(vocab) for _ in range(r.randrange(12, 40)))) for k in range(12)]
    items += [(90, "too short"), (91, None), (92, ""), (None, " ".join(r.choice(vocab) for _ in range(20)))]
    docs, truth = [], set()
    for d in range(80):
        w = [r.choice(vocab) for _ in range(r.randrange(0, 300))]
        if d % 4 == 0:
            i, text = items[d // 4 % 12]
            copy = text.split()
            if d % 8 == 0:  # an edited copy: words replaced, dropped and put in
                for at in range(4, len(copy), 7):
                    copy[at] = "changed"
                copy.insert(2, "extra")
                del copy[-2]
            w[len(w) // 2 : len(w) // 2] = [x.upper() + "," if k % 5 == 0 else x for k, x in enumerate(copy)]
            truth.add((d, i))
        docs.append((d, " ".join(w)))
    return docs, items, truth


def test_decontamination(spark):
    docs, items, truth = contaminated_corpus()
    d = spark.createDataFrame([*docs, (200, None), (201, "")], "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as score")
    i = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.contaminated(d.repartition(3), i).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == truth and len(rows) == len(truth)
    texts = dict(docs)
    for r in rows:  # whole words of the reported span, aligned in full
        a = re.findall(r"[a-z0-9]+", dict(items)[r.item_id])
        b = re.findall(r"[a-z0-9]+", texts[r.doc_id].lower())
        assert r.score == plain_alignment(a, b) == plain_alignment(a, b[r.start_word : r.end_word])
    small = decontaminate.contaminated(d, i, block=4).collect()  # several blocks of items
    assert {(r.doc_id, r.item_id) for r in small} == truth
    assert decontaminate.contaminated(d.where("false"), i).count() == 0
    assert decontaminate.contaminated(d, i.where("false")).count() == 0
    both = decontaminate.contaminated(d.selectExpr("cast(null as long) as doc_id", "text").union(d.select("doc_id", "text")), i)
    assert both.where("doc_id is null").count() == len(truth)


@pytest.mark.parametrize("beside_verbatim", [False, True])
def test_edited_copies(spark, beside_verbatim):
    """Copies with a word replaced in every 3 to 6, or words put in after each, whose own triples are the rarest of the corpus."""
    r = random.Random(11)
    vocab = [f"q{k}" for k in range(4000)] + ["the", "of", "and"] * 300
    items, docs, want = [], [], set()
    for n in (17, 30, 40, 60):
        for step in (3, 4, 5, 6, 0):
            item, text = len(items), [r.choice(vocab) for _ in range(n)]
            items.append((item, " ".join(text)))
            copy = [f"new{item}x{k}" if step and k % step == step - 1 else x for k, x in enumerate(text)]
            if not step:
                copy = " put ".join(text).split()
            assert plain_alignment(text, copy) >= n
            docs.append((item, " ".join([r.choice(vocab) for _ in range(20)] + copy + [r.choice(vocab) for _ in range(20)])))
            want.add((item, item))
            if beside_verbatim:
                docs.append((1000 + item, " ".join(text)))
                want.add((1000 + item, item))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = decontaminate.contaminated(d, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id) for x in got} == want and len(got) == len(want)
    for x in got:
        assert x.score == plain_alignment(items[x.item_id][1].split(), dict(docs)[x.doc_id].split())


def test_licenses(spark):
    r = random.Random(7)
    rows, want = [], set()
    for d in range(60):
        text = " ".join(r.choice(["één", "deux", "trois,", "license", "the", "under"]) for _ in range(r.randrange(0, 200)))
        if d % 3 == 0:
            name, notice = license_scan.TEMPLATES[d // 3 % len(license_scan.TEMPLATES)]
            text = text + "\n" + notice.upper() + "\nmore " + notice
            want |= {(d, name, text.index(notice.upper())), (d, name, text.rindex(notice))}
        rows.append((d, text))
    df = spark.createDataFrame([*rows, (100, None), (101, "")], "doc_id long, text string").selectExpr("*", "'x' as license")
    got = license_scan.scan(df.repartition(3)).collect()
    assert {(x.doc_id, x.license, x.start_char) for x in got} == want and all(x.coverage == 1 for x in got)
    texts = dict(rows)
    assert all(re.findall(r"\w+", texts[x.doc_id][x.start_char : x.end_char])[-1] for x in got)
    cut = spark.createDataFrame([(1, "permission is hereby granted to any person obtaining a copy")], "doc_id long, text string")
    assert license_scan.scan(cut).count() == 0
    part = license_scan.scan(cut, min_coverage=0.1).first()
    assert part.license == "MIT-text" and 0.1 < part.coverage < 0.2
    assert license_scan.scan(df.where("false")).count() == 0


def plain_tokens(word, pieces):
    known = dict(zip(pieces.pieces, pieces.scores, strict=True))
    best = [(0, 0)]
    for e in range(1, len(word) + 1):
        options = [(best[e - 1][0] + pieces.fallback, best[e - 1][1] - 1)]
        options += [(best[s][0] + known[word[s:e]], best[s][1] - 1) for s in range(e) if word[s:e] in known]
        best.append(max(options))
    return -best[-1][1]


def token_texts():
    r = random.Random(3)
    words = ["the", "token", "été", "naïve", "日本語", "a" * 70, "xyzzy" * 30, "don't", "🙂ok", "12345"]
    made = ["".join(r.choice("abcdeé") for _ in range(r.randrange(1, 12))) for _ in range(300)]
    return [(d, r.choice([" ", "\t", "\n"]).join(r.choice(words + made) for _ in range(r.randrange(0, 80)))) for d in range(40)]


def test_tokens(spark):
    pytest.importorskip("sentencepiece")
    pieces = token_counts.load()
    docs = [*token_texts(), (50, None), (51, ""), (None, "the"), (1, "the the")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "7 as n_tokens").repartition(3)
    got = sorted((r.doc_id or -1, r.n_pretokens, r.n_tokens) for r in token_counts.count_tokens(df, pieces).collect())
    want = []
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        want.append((d or -1, len(w), sum(plain_tokens(b" " + x.encode(), pieces) for x in w)))
    assert got == sorted(want)
    assert token_counts.count_tokens(df.where("false"), pieces).count() == 0


def plain_url(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if c.isascii() else c for c in host), path


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1?x#y", "http://example.com/en/", "http://example.com/en", "x://a.b.example.com/en/q",
            "http://www.example.com/en/é", "ftp://m.x.net/es/1", "http://net/fr/", "http://notcom/a", "http://a.com", "http://a.com/", "http://É.com/p://q",
            "http://host?a=://b", "http://x.org/en/" + "p" * 5000, "http://a.com//", "http://x.net/de/1", "http://x.net/es/2"]
    urls += [f"http://h{k}.net/{'es' if k % 2 else 'de'}/{k}" for k in range(60)]
    df = spark.createDataFrame([(k, u, "z") for k, u in enumerate(urls)], "page_id long, url string, host string").repartition(3)
    rows = {r.page_id: r for r in url_filter.judge(df).collect()}
    assert len(rows) == len(urls)
    for k, u in enumerate(urls):
        host, path = plain_url(u)
        fit = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, key=lambda r: len(r.pattern), default=None)
        r = rows[k]
        assert (r.host, r.path, r.rule) == (host, path, best.pattern if best else None), u
        assert r.verdict == (best.verdict if best else ("block" if r.score >= 0.5 else "allow"))
        assert (r.score is None) == (best is not None)
    assert url_filter.judge(df.where("false")).count() == 0
    again = {r.page_id: r.verdict for r in url_filter.judge(df.union(df)).collect()}
    assert len(again) == len(urls)


def test_url_model(spark):
    """Held-out accuracy on urls that no rule judges."""
    r = random.Random(5)
    def url(bad):
        return f"http://{r.choice(['casino', 'pills', 'spam']) if bad else r.choice(['uni', 'library', 'news'])}{r.randrange(999)}.org/{r.choice('abc')}{r.randrange(9999)}"
    known = spark.createDataFrame([(url(k % 2), "block" if k % 2 else "allow") for k in range(200)], "url string, verdict string")
    asked = spark.createDataFrame([(k, url(k % 2)) for k in range(200)], "page_id long, url string")
    got = url_filter.judge(asked, known).collect()
    assert np.mean([(x.verdict == "block") == bool(x.page_id % 2) for x in got]) > 0.97
