"""Registry of named queries: a Spark callable and, where SQL can say it, the equal DuckDB text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.numeric import signif

HOUR, FIVE_MINUTES, DAY = 3600, 300, 86400


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        if name in CATALOG:
            raise ValueError(f"{name} is registered twice")
        CATALOG[name] = Query(run, sql)
        return run

    return register


def present(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles to seven significant digits and instants without zone, to compare between engines."""
    if columns:
        df = df.select(*columns)
    shown = []
    for name, kind in df.dtypes:
        if kind == "double":
            shown.append(signif(name).alias(name))
        elif kind == "timestamp":
            shown.append(F.col(name).cast("timestamp_ntz").alias(name))
        else:
            shown.append(F.col(name))
    return df.select(*shown)
