"""Column contracts, and the gate that checks them before a costly stage."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

RINGS = T.ArrayType(
    T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
)

# Columns of the published district table, in order. Weather-pair
# columns carry the letters of the two perils.
OUTPUT_COLUMNS = (
    "name", "area", "country", "households",
    "sub_score", "wx_score", "fl_score", "gw_score",
    "geol", "sup_geol", "sup_frac",
    "wind_ms", "wdr_idx", "rain10_days", "precip_mm", "gust_rp50",
    "f_high", "f_low", "sw_high", "sw_low", "gw_frac", "sw_sev", "sw_depth_m",
    "er_score", "er_smp55", "er_smp105", "er_nfi55", "er_nfi105",
    "er_smp105_lo", "er_smp105_hi", "er_nfi105_lo", "er_nfi105_hi", "er_gi",
    "el_sub", "el_wx", "el_fl", "el_gw", "el_er", "el_total", "el_total5",
    "var995_vine", "tvar99_vine", "tvar99_gauss", "tvar99_indep",
    "tvar99_vine5", "tvar99_indep5", "tvar99_euler", "capital",
    "el_total_cc", "capital_cc", "premium_cc", "cc_uplift_pct", "cc_covered",
    "uplift_pct", "tail_dep_wf", "tail_dep_ws", "tail_dep_wg", "tail_dep_we",
    "theta_wf", "theta_ws", "theta_wg", "theta_we",
    "premium", "group", "geometry",
)
SIMULATED_COLUMNS = (
    "el_sub", "el_wx", "el_fl", "el_gw", "el_er", "el_total", "el_total5",
    "var995_vine", "var995_gauss", "var995_indep",
    "tvar99_vine", "tvar99_gauss", "tvar99_indep", "tvar99_vine5", "tvar99_indep5",
    "tvar99_euler", "el_year", "uplift_pct",
    "tail_dep_wf", "tail_dep_ws", "tail_dep_wg", "tail_dep_we",
    "theta_wf", "theta_ws", "theta_wg", "theta_we",
)
COMPUTED_COLUMNS = (
    "capital", "premium", "group",
    "el_total_cc", "capital_cc", "premium_cc", "cc_uplift_pct", "cc_covered",
)
SCORED_COLUMNS = tuple(c for c in OUTPUT_COLUMNS if c not in SIMULATED_COLUMNS + COMPUTED_COLUMNS)

SIMULATION_INPUTS = (
    "sub_score", "wx_score", "fl_score", "gw_score", "er_score",
    "f_high", "f_low", "sw_high", "sw_low", "gw_frac", "sw_sev", "er_frac", "households",
)


def missing_columns(df: DataFrame, contract: Iterable[str]) -> list[str]:
    """Contract columns the frame does not have."""
    return sorted(set(contract) - set(df.columns))


def require_columns(df: DataFrame, contract: Iterable[str], stage: str = "input") -> DataFrame:
    """Stop with the missing names before anything runs."""
    missing = missing_columns(df, contract)
    if missing:
        raise ValueError(f"{stage} lacks columns {missing}")
    return df
