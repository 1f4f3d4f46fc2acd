"""Sinks: order intents and fitted models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame


def write_orders(orders: DataFrame, path: str, mode: str = "append") -> None:
    """Order intents as Parquet, by side."""
    orders.write.mode(mode).partitionBy("side").parquet(path)


def model_path(root: str, symbol: str, side: str) -> str:
    return f"{root}/model_{symbol}_{side}"


def save_model(model: PipelineModel, root: str, symbol: str, side: str) -> str:
    path = model_path(root, symbol, side)
    model.write().overwrite().save(path)
    return path


def load_model(root: str, symbol: str, side: str) -> PipelineModel:
    return PipelineModel.load(model_path(root, symbol, side))
