"""Secret scan: fixed patterns, and values in a credential's place that are hard to guess."""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log10

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm import guessing
from barloom.session import materialize

# The base kinds in their order, each a pattern and the least length that counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of 24 or more; shorter runs fail anyway
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "guess")

# Names that a credential is given after, what stands between, and the value.
NAMES = (
    r"password|passwd|passphrase|passcode|(?<![a-z])pass|pwd|secret|token|credentials?|(?<![a-z])auth(?:orization)?|(?<![a-z])bearer"
    r"|(?:api|access|private|secret|account|signing|encryption)[\x20_-]?key"
)
CONTEXT = re.compile(
    rf"""(?:{NAMES})["'\])]?(?:\x20*(?:=>|:=|==?|:)\x20*(?:bearer\x20+|basic\x20+)?|\x20+is\x20+:?)["'(\[]?([^\s"'<>,;()\[\]]+)""",
    re.IGNORECASE | re.ASCII,
)
LEAST_VALUE = 6
STRONG = 10.0  # log10 guesses from which a value counts as a secret

SPAN = "struct<kind: string, start: int, `end`: int, cost: double>"
VALUE = "struct<start: int, `end`: int, value: string>"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, leftmost and without overlap within a kind, by start and kind."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def credential_values(text: str) -> list[tuple[int, int, str]]:
    """(start, end, value) of what stands in a credential's place; a full stop at the end is the sentence's."""
    out = []
    for m in CONTEXT.finditer(text):
        value = m[1].rstrip(".:!?")
        if len(value) >= LEAST_VALUE:
            out.append((m.start(1), m.start(1) + len(value), value))
    return out


def found(docs: DataFrame) -> DataFrame:
    """(_row, _key, base, values): what the patterns find in each text; a written table."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, values = [], []
            for text in b.column(2):
                s = text.as_py() or ""
                base.append([{"kind": k, "start": i, "end": j, "cost": None} for k, i, j in base_spans(s)])
                values.append([{"start": i, "end": j, "value": v} for i, j, v in credential_values(s)])
            span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("cost", pa.float64())])
            value = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(base, pa.list_(span)), pa.array(values, pa.list_(value))], ["_row", "_key", "base", "values"]
            )

    d = docs.withColumn("_row", F.monotonically_increasing_id()).select("_row", "_key", "_text")
    kind = d.schema["_key"].dataType.simpleString()
    return materialize(d.mapInArrow(scan, f"_row long, _key {kind}, base array<{SPAN}>, `values` array<{VALUE}>"), "secrets")


def words_of(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}{3,}"), F.lit(0)), lambda w: F.length(w) <= guessing.LONGEST_WORD)


def word_counts(docs: DataFrame, values: DataFrame) -> DataFrame:
    """(word, n) of all texts, without what stands in credentials' places: a secret does not make itself a word."""
    used = docs.select(F.explode(words_of(F.col("_text"))).alias("word"), F.lit(1).alias("n"))
    own = values.select(F.explode(words_of(F.col("value"))).alias("word"), F.lit(-1).alias("n"))
    return used.union(own).groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")


def guess_costs(values: DataFrame, words: DataFrame) -> DataFrame:
    """(value_id, cost) of distinct values (value_id, value), with the words that each contains, priced by frequency."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                parts = list(dict.fromkeys(guessing.spellings(value)))
                for lo in range(0, len(parts), 65536):
                    part = parts[lo : lo + 65536]
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(part), pa.binary()), pa.array(part, pa.string())], ["value_id", "word"])

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            costs = []
            for value, known in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words_here = {w["word"]: log10(max(total / w["n"], 1.0)) for w in known or ()}
                costs.append(guessing.segment(value, words_here)[0])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(costs, pa.float64())], ["value_id", "cost"])

    total = words.agg(F.sum("n")).first()[0] or 0  # one number
    parts = materialize(values.mapInArrow(spell, "value_id binary, word string"), "spellings")  # many rows a value: a join has to know
    known = parts.join(words, "word").groupBy("value_id").agg(F.collect_list(F.struct("word", "n")).alias("words"))
    priced = values.join(known, "value_id", "left").select("value_id", "value", "words")
    return priced.mapInArrow(price, "value_id binary, cost double")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", strong: float = STRONG, words: DataFrame | None = None) -> DataFrame:
    """(key, findings) per row: spans in code points (end exclusive) by start and kind, each (kind, start, end, cost).

    `assign`, `access` and `hex` are fixed patterns, `guess` is a value in a credential's place
    (after a name such as "password" and a separator) whose cheapest segmentation into words, dates,
    repeats, keyboard walks and brute force takes 10^`strong` guesses or more; `cost` is that
    exponent, null for the others. Words are priced by their frequency in all the texts, or by
    `words` (word in lower case, n).

    Null texts count as empty; null keys and repeated rows are kept, each scanned by itself; an
    empty table gives an empty result; texts and values of any length count whole; other columns
    are not read. Equal values get equal costs wherever they stand.
    """
    d = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    first = found(d)
    each = first.select("_row", F.explode("values").alias("v")).select("_row", "v.*")
    each = each.withColumn("value_id", F.unhex(F.sha2(F.col("value").cast("binary"), 256)))
    if words is None:
        words = materialize(word_counts(d, each), "words")
    values = materialize(each.select("value_id", "value").dropDuplicates(["value_id"]), "values")
    hard = materialize(guess_costs(values, words).where(F.col("cost") >= strong), "guess-costs")
    span = F.struct(F.lit("guess").alias("kind"), "start", "end", "cost").cast(SPAN)
    more = each.join(hard, "value_id").groupBy("_row").agg(F.collect_list(span).alias("more"))
    none = F.array().cast(f"array<{SPAN}>")
    place = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    ranked = F.transform(
        F.concat("base", F.coalesce("more", none)),
        lambda s: F.struct(s.start.alias("start"), place[s.kind].alias("rank"), s.end.alias("end"), s.kind.alias("kind"), s.cost.alias("cost")),
    )
    spans = F.transform(F.array_sort(ranked), lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end"), s.cost.alias("cost")))
    return first.join(more, "_row", "left").select(F.col("_key").alias(key), spans.alias("findings"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def digests(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans) of `scan`'s rows."""
    of = {k: F.expr(f"filter(findings, s -> s.kind = '{k}')") for k in KINDS}
    base = F.filter("findings", lambda s: s.kind != "guess")
    return findings.select(
        key, *[F.size(of[k]).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("findings")).alias("spans"),
    )
