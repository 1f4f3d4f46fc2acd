"""The batch job's base table, against the single operators' SQL texts joined bar by bar."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import quotes as Q
from barloom.plans import batch
from barloom.plans import sqltext as S
from barloom.plans import q_quotes  # noqa: F401  its texts are parts of the base table's
from barloom.plans.catalog import CATALOG, HOUR, present, query
from barloom.plans.q_features import hourly
from barloom.plans.q_quotes import INPUTS
from barloom.session import materialize
from barloom.sources import fixtures

# Which named query has which base columns.
PARTS = {
    "bars_in": ("open", "high", "low", "close", "volume", "inventory", "gamma"),
    "vwap_hl": ("vwap",),
    "vwap_bar_open": ("D_vwap",),
    "q_k": ("k",),
    "q_alpha": ("bid_alpha", "ask_alpha"),
    "f_range_spread": ("spread3", "spread2"),
    "f_volatility5": ("Volatility",),
    "f_volatility_mom": ("Volatility_mom", "Volatility3_mom"),
    "f_vol_of_vol5": ("Volatility2",),
    "f_volatility25": ("Volatility3",),
    "f_vol_of_vol25": ("Volatility4",),
    "f_volatility_ratio": ("Volatility_ratio", "Volatility_ratio_reversed"),
    "f_tradeable_spread": ("trade_able_spread",),
    "f_last_return": ("last_return",),
    "f_last_return_roll": ("last_return_5mu", "last_return_5_sum", "last_return_10mu", "last_return_10_sum"),
    "f_std_normalized": ("std_normalized",),
    "f_ma_ratio": ("ma_ratio",),
    "f_obv": ("OBV", "OBV1"),
    "f_rsi": ("rsi_open", "rsi_close", "rsi_volume", "rsi_D_vwap"),
    "f_log_spread": ("spread",),
    "f_variance": ("variance",),
    "f_var_bands": ("open_plus_var", "open_minus_var"),
    "f_var_band_diff": ("open_var_diff",),
    "f_mu": ("mu",),
    "f_sigma": ("sigma",),
    "f_volume_plus1": ("volume_p1",),
    "f_market_impact": ("market_impact",),
    "q_spread_sym": ("bid_spread_aysm", "ask_spread_aysm"),
    "q_spread_drift": ("bid_spread_aysm2", "ask_spread_aysm2"),
    "q_d_gamma": ("inventory_risk_roc", "inventory_risk_roc_norm"),
    "q_d_inventory": ("inventory_derivative",),
    "q_d_sigma": ("sigma_derivative",),
    "q_d_k": ("k_derivative",),
    "q_d_a": ("a_derivative",),
    "q_integrals": ("indefinite_integral", "indefinite_integral2"),
}


def joined_sql() -> str:
    """All parts side by side; what is missing is the filler 1e-7, as at the end of the job."""
    with_, joins = [], []
    for name, columns in PARTS.items():
        if name == "bars_in":
            body = S.chain(*INPUTS) + f"select {S.keyed(*columns)} from b1"
        else:
            body = CATALOG[name].sql
        with_.append(f"p_{name} as materialized ({body})")
        joins.append(f"p_{name}" if not joins else f"left join p_{name} using (symbol, bar_ts)")
    shown = ", ".join(f"coalesce(p_{n}.{c}, 1e-7) as {c}" for n, columns in PARTS.items() for c in columns)
    return f"with {', '.join(with_)} select symbol, bar_ts, {shown} from {' '.join(joins)}"


def desk_bars(spark, sf_dir):
    held = fixtures.event_positions(spark, sf_dir)
    return materialize(Q.gamma(Q.inventory(hourly(spark, sf_dir), held), held), "desk-bars")


BASE_SQL = ("base", joined_sql())
CELLS_SQL = (
    "cells",
    f"""select symbol, bar_ts, feature, value, by_volume, by_variance
        from (select *, volume as by_volume, variance as by_variance from base) unpivot (value for feature in ({", ".join(batch.BASE)}))""",
)


@query("base_table", BASE_SQL[1])
def base_table(spark, sf_dir):
    """All 57 base columns of the batch job."""
    return present(batch.base_features(desk_bars(spark, sf_dir), HOUR))


WRITTEN: dict[tuple, object] = {}


def shared(name, spark, sf_dir, make):
    """A written table that queries of one session on the same input files share."""
    source = (name, spark.sparkContext.applicationId, *sorted(fixtures.table(spark, sf_dir, "events").inputFiles()))
    if source not in WRITTEN:
        WRITTEN[source] = make()
    return WRITTEN[source]


def base(spark, sf_dir):
    """The base table as `base_table` shows it, so that both engines' further steps start from equal numbers."""
    shown = lambda: base_table(spark, sf_dir).withColumn("bar_ts", F.col("bar_ts").cast("timestamp"))
    return shared("base", spark, sf_dir, lambda: materialize(shown(), "base-table"))
