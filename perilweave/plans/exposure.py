"""Exposure and flag shares by district from unit-postcode tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import has_code_prefix, outward_code
from ..operators.lookup import apportion


def flag_share(units: DataFrame, key: str, flag: str, wanted: str = "possible") -> DataFrame:
    """Share of units whose flag matches, to five decimals, and their number."""
    hit = F.lower(F.trim(F.col(flag))) == wanted
    return units.groupBy(key).agg(
        F.round(F.count_if(hit) / F.count(F.lit(1)), 5).alias("gw_frac"),
        F.count(F.lit(1)).alias("n_postcodes"),
    )


def exposure_by_district(
    postcodes: DataFrame, census: DataFrame, pooled_prefix: str = "S", pooled_total: float = 0.0,
    left_out: str = "N",
) -> DataFrame:
    """Households per outward code.

    ``postcodes`` has (postcode, area); ``census`` has (area, households). An
    area's households are shared by its postcodes; areas of one nation without
    a usable census share a national total instead.
    """
    live = postcodes.where(
        (F.trim("postcode") != "") & (F.trim("area") != "") & ~has_code_prefix(F.col("area"), [left_out])
    ).select(outward_code(F.col("postcode")).alias("name"), F.trim("area").alias("area"))
    return apportion(
        live.where("name <> ''"), census, "area", "name", "households",
        pooled=F.col("area").startswith(pooled_prefix), pooled_total=pooled_total,
    ).select("name", "households", F.col("members").alias("postcodes"), "unmatched")
