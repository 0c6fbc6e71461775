"""Sampling operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import running


def systematic_sample(df: DataFrame, key: str, step: int) -> DataFrame:
    """Every ``step``-th row in key order, starting with the first."""
    ranked = running(df, key, key, rank="_rn")
    return ranked.where((F.col("_rn") - 1) % step == 0).drop("_rn")
