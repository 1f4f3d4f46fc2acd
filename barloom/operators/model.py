"""Boosted-tree classifiers on Spark ML.

One model serves all symbols of a side unless rows are filtered to one symbol first; training is
distributed over the rows. The loops below run on the driver, but every turn is a Spark job.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.bars import last_bars


@dataclass(frozen=True)
class Params:
    depth: int = 3
    step: float = 0.1
    subsample: float = 1.0


def train(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    iterations: int = 20,
    params: Params = Params(),
    seed: int = 42,
    valid: str | None = None,
) -> PipelineModel:
    """Fit on the rows; with `valid`, a boolean column, its rows only stop the boosting when they no longer gain."""
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    booster = GBTClassifier(
        featuresCol="features",
        labelCol=label,
        predictionCol="prediction",
        maxIter=iterations,
        maxDepth=params.depth,
        stepSize=params.step,
        subsamplingRate=params.subsample,
        seed=seed,
    )
    held = [valid] if valid else []
    if valid:
        booster = booster.setValidationIndicatorCol(valid)
    vectors = assembler.transform(df.select(*features, F.col(label).cast("double").alias(label), *held))
    return PipelineModel([assembler, booster.fit(vectors.select("features", label, *held))])


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    scored = model.transform(df).withColumn("pred", F.col("prediction").cast("int"))
    return scored.drop("features", "rawPrediction", "probability", "prediction")


def predict_last(model: PipelineModel, df: DataFrame, n: int = 2) -> DataFrame:
    """Predictions for the last n bars per symbol; `newest` marks the one that decides."""
    scored = predict(model, last_bars(df, n))  # n rows per symbol, so the window below is small
    latest = Window.partitionBy("symbol").orderBy(F.col("bar_ts").desc())
    return scored.withColumn("newest", F.row_number().over(latest) == 1)


def importances(model: PipelineModel, features: Sequence[str]) -> dict[str, float]:
    """One weight per feature: as many values as the feature list has, not as the data."""
    return dict(zip(features, model.stages[-1].featureImportances.toArray()))


def select_features(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    keep: int,
    steps: int = 4,
    iterations: int = 10,
    seed: int = 42,
) -> tuple[list[str], PipelineModel]:
    """Drop the least useful features in equal steps until `keep` are left, then fit once more."""
    left = list(features)
    drop_per_step = math.ceil(max(len(left) - keep, 0) / steps)
    while len(left) > keep:
        weight = importances(train(df, left, label, iterations, seed=seed), left)
        ranked = sorted(left, key=lambda c: (-weight[c], left.index(c)))
        left = sorted(ranked[: max(keep, len(left) - drop_per_step)], key=left.index)
    return left, train(df, left, label, iterations, seed=seed)


# The ranges searched.
DEPTHS = range(2, 7)
STEPS = [0.001 + i * (1 - 0.001) / 99 for i in range(100)]
SUBSAMPLES = [0.75, 0.8125, 0.875, 0.9375, 1.0]


def candidates(count: int, seed: int = 42) -> list[Params]:
    pick = random.Random(seed)
    return [Params(pick.choice(DEPTHS), pick.choice(STEPS), pick.choice(SUBSAMPLES)) for _ in range(count)]


@dataclass
class SearchResult:
    best: Params
    score: float
    iterations: int
    rounds: list[tuple[int, int, float]] = field(default_factory=list)  # iterations, candidates, best score


def fold_f1(folds: DataFrame, features: Sequence[str], label: str, iterations: int, p: Params, seed: int) -> float:
    """Mean F1 of class 1 over the folds."""
    scores = []
    numbers = sorted(r["fold"] for r in folds.select("fold").distinct().collect())  # one row per fold
    for k in numbers:
        part = folds.filter(F.col("fold") == k)
        model = train(part.filter("role = 'train'"), features, label, iterations, p, seed)
        hits = predict(model, part.filter("role = 'test'")).agg(
            F.sum(F.when((F.col(label) == 1) & (F.col("pred") == 1), 1).otherwise(0)).alias("tp"),
            F.sum(F.when(F.col(label) != F.col("pred"), 1).otherwise(0)).alias("wrong"),
        )
        tp, wrong = hits.first()
        scores.append(2 * tp / (2 * tp + wrong) if tp else 0.0)
    return sum(scores) / len(scores)


def search(
    folds: DataFrame,
    features: Sequence[str],
    label: str,
    count: int | None = None,
    min_iterations: int = 25,
    max_iterations: int = 500,
    factor: int = 10,
    seed: int = 42,
) -> SearchResult:
    """Random search with successive halving: the budget is boosting iterations.

    Each round keeps the best 1/factor of the candidates and gives them factor times the
    iterations. `count` defaults to as many candidates as leave one for the largest budget.
    """
    rounds = 1 + int(math.log(max_iterations / min_iterations, factor) + 1e-9)
    pool = candidates(count or factor ** (rounds - 1), seed)
    result = SearchResult(pool[0], -1.0, min_iterations)
    budget = min_iterations
    for _ in range(rounds):
        scored = [(fold_f1(folds, features, label, budget, p, seed), i) for i, p in enumerate(pool)]
        scored.sort(key=lambda x: (-x[0], x[1]))
        result.rounds.append((budget, len(pool), scored[0][0]))
        result.best, result.score, result.iterations = pool[scored[0][1]], scored[0][0], budget
        if len(pool) == 1:
            break
        pool = [pool[i] for _, i in scored[: max(1, len(pool) // factor)]]
        budget = min(budget * factor, max_iterations)
    return result
