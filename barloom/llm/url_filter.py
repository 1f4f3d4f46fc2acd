"""URL filter: longest matching rule, else logistic regression on hashed character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """`pattern` is host/path; it fits its host and all subdomains if the path starts with the rule's."""

    pattern: str
    verdict: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]


# The rules of the task.
RULES = (
    Rule("com/", "allow"),
    Rule("example.com/en/", "block"),
    Rule("www.example.com/en/", "allow"),
    Rule("net/es/", "block"),
    Rule("net/fr/", "block"),
)


def parse(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def with_parts(pages: DataFrame, key: str, url: str) -> DataFrame:
    d = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"))
    host, path = parse(F.col("_url"))
    return d.select("_key", host.alias("host"), path.alias("path"))


def matched_rule(rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits host and path, or null. Ties in length go to the first in order."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.pattern)):
        on_host = (F.col("host") == r.host) | F.endswith(F.col("host"), F.lit("." + r.host))
        out = F.when(on_host & F.startswith(F.col("path"), F.lit(r.path)), r.pattern).otherwise(out)
    return out


def ngrams(low: int = 3, high: int = 5) -> Column:
    """Distinct character n-grams of host and path, each marked with the part it is from."""
    parts = []
    for part in ("host", "path"):
        text = f"concat('^', {part}, '$')"
        for n in range(low, high + 1):
            parts.append(
                f"transform(sequence(1, greatest(1, length({text}) - {n - 1})), i -> concat('{part[0]}', substring({text}, i, {n})))"
            )
    return F.array_distinct(F.expr(f"concat({', '.join(parts)})"))


def train(labelled: DataFrame, bits: int = 16, max_labelled: int = 4000, reg: float = 1e-3) -> LogisticRegressionModel | str:
    """Fit on at most `max_labelled` rows of (host, path, verdict), the first by a hash of host and path.

    The fit is on a bounded sample; everything else judges every row. With one verdict only, or no
    rows at all, that verdict (or "allow") is returned in place of a model.
    """
    rows = labelled.where(F.col("verdict").isin("allow", "block"))
    rows = rows.orderBy(F.xxhash64("host", "path"), "host", "path", "verdict").limit(max_labelled)
    data = HashingTF(numFeatures=1 << bits, binary=True, inputCol="grams", outputCol="features").transform(
        rows.withColumn("grams", ngrams()).withColumn("label", (F.col("verdict") == "block").cast("double"))
    ).select("features", "label").cache()
    try:
        seen = {r.label for r in data.select("label").distinct().collect()}
        if len(seen) < 2:
            return "block" if seen == {1.0} else "allow"
        return LogisticRegression(maxIter=40, regParam=reg, standardization=False, tol=1e-6).fit(data)
    finally:
        data.unpersist()


def judge(
    pages: DataFrame,
    labelled: DataFrame | None = None,
    rules: tuple[Rule, ...] = RULES,
    key: str = "page_id",
    url: str = "url",
    bits: int = 16,
    max_labelled: int = 4000,
    threshold: float = 0.5,
) -> DataFrame:
    """One row per input row: key, host, path, rule, score, verdict.

    `labelled` is a small table (url, verdict in allow/block). Without one, the pages that a rule
    judges serve as it. `score` is the model's probability of "block", null where a rule decides.
    Null urls and urls without `://` have empty host and path, fit no rule and are scored like any
    other. Repeated rows are judged each; an empty table gives an empty result; other columns of the
    input are not read. Urls of any length are taken whole.
    """
    parts = with_parts(pages, key, url).withColumn("rule", matched_rule(rules))
    verdicts = F.lit(None).cast("string")
    for r in rules:
        verdicts = F.when(F.col("rule") == r.pattern, r.verdict).otherwise(verdicts)
    parts = parts.withColumn("_verdict", verdicts)
    if labelled is None:
        known = parts.where("rule is not null").select("host", "path", F.col("_verdict").alias("verdict"))
    else:
        known = with_parts(labelled.select(F.col("verdict").alias("_v"), F.col("url").alias("_u")), "_v", "_u")
        known = known.withColumnRenamed("_key", "verdict")
    model = train(known, bits, max_labelled)
    if isinstance(model, str):
        scored = parts.withColumn("score", F.when(F.col("rule").isNull(), 1.0 if model == "block" else 0.0))
    else:
        asked = F.when(F.col("rule").isNull(), ngrams()).otherwise(F.array().cast("array<string>"))
        tf = HashingTF(numFeatures=1 << bits, binary=True, inputCol="grams", outputCol="features")
        scored = model.transform(tf.transform(parts.withColumn("grams", asked)))
        scored = scored.withColumn("score", F.when(F.col("rule").isNull(), vector_to_array("probability")[1]))
    by_score = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select(
        F.col("_key").alias(key), "host", "path", "rule", "score", F.coalesce("_verdict", by_score).alias("verdict")
    )
