"""Headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every job runs twice. `queries` has the second (warm) run, `cold` the first. Results go to Spark's
noop sink, so all rows and columns are computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame

from barloom.operators import bars as B
from barloom.operators import book as K
from barloom.operators import decisions as D
from barloom.operators import quotes as Q
from barloom.operators import scenarios as C
from barloom.operators import transforms as T
from barloom.operators.rsi import rsi
from barloom.plans import batch
from barloom.session import local_session, materialize
from barloom.sources import fixtures as X

HOUR, FIVE_MINUTES, DAY = 3600, 300, 86400
SEQ_BITS = 30  # event ids of the fixture stay far below a billion


def jobs(spark, sf):
    """Name to (input rows, callable). Inputs shared by several jobs are written beforehand."""
    wide = X.trades_wide(spark, sf)
    hourly = materialize(B.bars(wide, HOUR, seq_bits=SEQ_BITS - 2), "bench-hourly")
    held = hourly.select("symbol").distinct().withColumn("qty", _qty())
    desk_bars = materialize(Q.gamma(Q.inventory(hourly, held), held), "bench-desk")
    few = materialize(B.bars(X.trades(spark, sf), HOUR), "bench-few")
    few = Q.gamma(Q.inventory(few, X.event_positions(spark, sf)), X.event_positions(spark, sf))
    base = materialize(batch.base_features(few, HOUR), "bench-base")
    expanded = materialize(batch.expanded(base, HOUR), "bench-expanded")
    trades, lines, n = wide.count(), spark.read.parquet(f"{sf}/lineitem.parquet").count(), hourly.count()
    cells = expanded.count()
    return {
        "bars_300s": (trades, lambda: B.bars(wide, FIVE_MINUTES, seq_bits=SEQ_BITS)),
        "bars_daily": (lines, lambda: B.bars(X.trades_daily(spark, sf), DAY)),
        "vwap_trade": (trades, lambda: B.vwap_trade(X.trades(spark, sf))),
        "base_features": (n, lambda: batch.base_features(desk_bars, HOUR)),
        "rsi": (n, lambda: rsi(hourly, HOUR, ["open", "close"], n=14)),
        "quote_model": (n, lambda: Q.spread_drift(Q.quote_inputs(desk_bars, HOUR))),
        "expand_cells": (base.count() * len(batch.BASE), lambda: batch.expanded(base, HOUR)),
        "zscore_cells": (cells, lambda: T.zscore_expanding(expanded, HOUR)),
        "winsorize_cells": (cells, lambda: T.winsorize_global(expanded)),
        "scenario_stats": (n, lambda: C.terminal_stats(C.params(hourly, HOUR))),
        "book_alpha": (lines, lambda: K.book_alpha(K.weighted_depth(K.book_depth(X.book_quotes(spark, sf), 10, X.BOOK_ORDER)))),
        "exit_ladder": (lines, lambda: D.match_ladder(X.positions(spark, sf), X.desk(spark, sf))),
    }


def _qty():
    from pyspark.sql import functions as F

    return (F.pmod(F.xxhash64("symbol"), F.lit(400)) - 200).cast("double")


def timed(run) -> float:
    start = time.perf_counter()
    out: DataFrame = run()
    out.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "barloom-bench")
    spark.sparkContext.setLogLevel("ERROR")
    rows, cold, warm = {}, {}, {}
    for name, (count, run) in jobs(spark, sf).items():
        rows[name] = count
        cold[name] = round(timed(run), 3)
        warm[name] = round(timed(run), 3)
    print(
        json.dumps(
            {
                "metric": "total_warm_seconds",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus) if cpus.isdigit() else cpus,
                "cold": cold,
                "input_rows": rows,
                "rows_per_sec": {k: int(rows[k] / warm[k]) for k in warm},
            }
        )
    )


if __name__ == "__main__":
    main()
