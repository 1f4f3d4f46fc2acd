"""Imports every group of named queries and defines the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.operators.bars import bars, vwap_hl
from barloom.operators.features import f_volatility5
from barloom.plans import q_bars, q_base, q_batch, q_decisions, q_features, q_model, q_quotes, q_streaming, q_transforms  # noqa: F401
from barloom.plans.catalog import CATALOG, FIVE_MINUTES
from barloom.session import materialize
from barloom.sources import fixtures

__all__ = ["CATALOG", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades to gap-free bars, volatility and running volume-weighted price per symbol and bar."""
    b = materialize(bars(fixtures.trades(spark, sf_dir), FIVE_MINUTES), "bars")  # read by both features
    out = vwap_hl(f_volatility5(b, FIVE_MINUTES), FIVE_MINUTES)
    return out.select("symbol", "bar_ts", "open", "high", "low", "close", "volume", "Volatility", "vwap")
