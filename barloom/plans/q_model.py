"""Models per symbol and side over all 684 columns of the batch form.

SQL cannot fit trees, so these queries have no text: tests/test_forest.py compares the fits with a
plain one, and kept models with the fitted ones.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import cellblocks as C
from barloom.operators import labels as L
from barloom.operators import forest as R
from barloom.operators import symbol_models as M
from barloom.plans import batch
from barloom.plans.catalog import HOUR, present, query
from barloom.plans.q_base import base, shared
from barloom.session import materialize, new_path

TREES, PATIENCE = 25, 5
SELECT_TREES = 5  # a step of the selection; README.md has the time of more
SEARCH = {"count": 4, "min_trees": 5, "max_trees": 10, "factor": 2}  # README.md has the time of the operator's own budgets
KEEP = 30


def chain(spark, sf_dir):
    """Base table and normalised cells in blocks, both written."""
    bars = base(spark, sf_dir)
    return bars, shared("cells", spark, sf_dir, lambda: materialize(batch.cell_blocks(bars, HOUR), "cells"))


def fitted(spark, sf_dir):
    bars, cells = chain(spark, sf_dir)
    data = M.inputs(cells, bars, HOUR, batch.columns())
    return bars, cells, data, M.train(data, TREES, PATIENCE)


def scored(data, models):
    """Predictions of the fitted models with symbol, side and split."""
    spark = data.table.sparkSession
    sides = spark.createDataFrame([(i, m.spec.name) for i, m in enumerate(models)], "model int, side string")
    out = R.score(data.table, len(data.names), models).join(F.broadcast(sides), "model")  # a row per model
    return out.join(data.rows.select("symbol", "bar_ts", "split"), ["symbol", "bar_ts"], "left")


@query("ml_train_classifier")
def ml_train_classifier(spark, sf_dir):
    """Accuracy and macro F1 of every symbol's and side's model on each part of the time split."""
    _, _, data, models = fitted(spark, sf_dir)
    at = materialize(scored(data, models).where("label is not null").withColumnRenamed("label", "y"), "scored")
    by = ("symbol", "side", "split")
    counts = at.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("y") == 1).alias("ups"))
    return present(counts.join(L.metrics(at, *by), list(by)))


@query("ml_features_select")
def ml_features_select(spark, sf_dir):
    """The features that are left of 684 per symbol and side, with their share of the gain."""
    bars, cells = chain(spark, sf_dir)
    data = M.inputs(cells, bars, HOUR, batch.columns())
    kept, models = M.select_features(data, KEEP, trees=SELECT_TREES)
    weights = [(m.spec.symbol, m.spec.name, n, M.importances(m, data.names).get(n, 0.0)) for m in models for n in kept[m.spec.symbol, m.spec.name]]
    return present(spark.createDataFrame(weights, "symbol string, side string, feature string, importance double"))


@query("ml_search")
def ml_search(spark, sf_dir):
    """Rounds of the halving search per symbol and side, on three forward folds of the selected features."""
    bars, cells = chain(spark, sf_dir)
    first = M.inputs(cells, bars, HOUR, batch.columns())
    kept = {}
    for m in M.train(first, SELECT_TREES, 0):
        found = list(M.importances(m, first.names))
        kept[m.spec.symbol, m.spec.name] = (found + [n for n in first.names if n not in found])[:KEEP]
    names = sorted({n for own in kept.values() for n in own})
    data = M.inputs(cells.where(F.col("feature").isin(names)), bars, HOUR, names, folds=3, gap=1)
    return present(M.search(data, kept, **SEARCH))


@query("ml_predict")
def ml_predict(spark, sf_dir):
    """Predictions of both sides' models for the last two bars per symbol, from their cells."""
    bars, cells, data, models = fitted(spark, sf_dir)
    return present(M.predict(M.newest(cells, bars, 2, HOUR), M.tree_rows(data, models)))


@query("sink_model")
def sink_model(spark, sf_dir):
    """Models saved by symbol and side, loaded, and applied to all cells; `fitted_pred` is what the fitted ones say."""
    bars, cells, data, models = fitted(spark, sf_dir)
    root = new_path(spark, "models")
    M.save(M.tree_rows(data, models), root)
    again = M.predict(C.to_long(cells, HOUR), M.load(spark, root))
    both = again.join(scored(data, models).select("symbol", "side", "bar_ts", F.col("pred").alias("fitted_pred")), ["symbol", "side", "bar_ts"])
    return present(both)


@query("batch_predictions")
def batch_predictions(spark, sf_dir):
    """The batch job to its end: bracket orders of the newest predictions, with the newest bar's quotes."""
    bars, cells = chain(spark, sf_dir)
    predicted = batch.predictions(cells, bars, HOUR, TREES, PATIENCE)
    newest = bars.groupBy("symbol").agg(F.max_by(F.struct("close", "bid_spread_aysm2", "ask_spread_aysm2", "gamma"), "bar_ts").alias("b"))
    desk = newest.select(
        "symbol", F.col("b.close").alias("res"), F.col("b.bid_spread_aysm2").alias("best_bid"), F.col("b.ask_spread_aysm2").alias("best_ask"),
        F.col("b.gamma").alias("risk"),
    )
    return present(batch.orders(predicted, desk))
