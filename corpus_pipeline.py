"""A training corpus in five stages: quality, boilerplate lines, near-duplicates, benchmark leaks, mixture.

Each stage takes all that the one before it kept, as a Parquet table, and its decisions take effect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import decontaminate, line_dedup, mixing, ngram_join, quality
from barloom.session import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Each row is judged by its text alone: rows without an id and repeated rows as any other, null and
    empty texts as texts without words.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rated = labels.select("doc_id", quality.grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    return quality.select_good(docs.select(*COLUMNS), rated)


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go; every document stays, with its new length.

    Rows without an id and repeated rows are cut each by itself; a null text stays null, an empty one empty.
    """
    out = line_dedup.dedup_lines(docs, carry=("lang", "source"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every class of near-duplicates the document with the least id stays.

    A repeated row is a copy like any other: one of the rows stays. A row without an id stays only
    if no copy has one, and then one such row does. Null and empty texts are copies of nothing.
    """
    rows = materialize(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")
    classes = ngram_join.similarity_classes(rows, id_col="row").select("row", "class_id")
    first = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")
    kept = rows.select("row", "doc_id").join(classes, "row").groupBy("class_id").agg(F.min(first).alias("first"))
    return rows.join(kept.select("first.row"), "row", "left_semi").select(*COLUMNS)


def no_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a copy of a benchmark item go.

    A document is known by its text here, so rows without an id and repeated rows go or stay with
    their text. Null and empty texts hold no copy.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    texts = docs.select(*COLUMNS).withColumns({"a": F.xxhash64("text"), "b": F.xxhash64(F.lit(7), "text")})
    hits = decontaminate.contaminated(texts, items, id_col="a", keep=("b",)).select("a", "b").distinct()
    return texts.join(hits, ["a", "b"], "left_anti").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at rates that meet the target weights, with the number of their copies.

    Texts without words have no weight and are not drawn; nulls in a dimension are a group; rows
    without an id share one draw, and repeated rows are drawn alike.
    """
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", cut_lines),
    ("n-gram join", one_of_each),
    ("decontamination", no_leaks),
    ("source mix", mixture),
]
ORACLE_SQL = None  # the first stage is a trained model; tests/llm compares the rest with plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
