"""Calibration of frequencies and systemic loadings to published totals."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.copula import EDGE, TINY, clip, conditional_claim_score
from ..functions.normal import with_norm_cdf, with_norm_ppf
from . import assumptions as A
from .marginals import marginal_frequency


def weighted_mean(value: str | Column, weight: str) -> Column:
    """Aggregate: exposure-weighted mean."""
    v = F.col(value) if isinstance(value, str) else value
    return F.try_divide(F.sum(v * F.col(weight)), F.sum(weight))


def frequency_multipliers(scored: DataFrame) -> DataFrame:
    """One row with the factor that brings each peril to its published frequency."""
    raw = marginal_frequency(scored)
    return raw.agg(
        *[
            (A.TARGET_FREQUENCY[k] / weighted_mean(f"p_{k}", "households")).alias(k)
            for k in A.INSURED
        ]
    )


def tail_frequency(rated: DataFrame, factors: list[float]) -> DataFrame:
    """Mean claim frequency of a 1-in-100 year for each loading factor, in one pass."""
    z = F.lit(NormalDist().inv_cdf(0.99))
    p = {k: F.col(f"p_{k}") for k in A.INSURED}
    rows = rated.select("households", *p.values()).withColumns(
        {f"_o_{k}": clip(1 - c, TINY, 1 - TINY) for k, c in p.items()}
    )
    rows = with_norm_ppf(rows, {f"_t_{k}": f"_o_{k}" for k in p})
    rows = rows.withColumn("factor", F.explode(F.array(*[F.lit(float(f)) for f in factors])))
    rows = rows.withColumns(
        {
            f"_l_{k}": F.least(F.lit(A.BASE_LOADING[k]) * F.col("factor"), F.lit(A.LOADING_CAP))
            for k in p
        }
    )
    rows = rows.withColumns(
        {f"_s_{k}": conditional_claim_score(z, F.col(f"_t_{k}"), F.col(f"_l_{k}")) for k in p}
    )
    rows = with_norm_cdf(rows, {f"_q_{k}": f"_s_{k}" for k in p})
    return rows.groupBy("factor").agg(
        weighted_mean(F.expr(" + ".join(f"_q_{k}" for k in p)), "households").alias("tail"),
        weighted_mean(F.expr(" + ".join(f"p_{k}" for k in p)), "households").alias("mean"),
    )


def calibrate_loading(
    rated: DataFrame, ratio: float = A.TAIL_FREQUENCY_RATIO, lo: float = 0.01, hi: float = 1.0,
    points: int = 128, rounds: int = 5,
) -> float:
    """Loading factor whose 1-in-100 year claims ``ratio`` times the mean year.

    The tail frequency grows with the factor, so each round evaluates a grid of
    factors in one job and keeps the step that brackets the target. The only
    values that reach the driver are the grid points of a round.
    """
    for _ in range(rounds):
        grid = [lo + (hi - lo) * i / (points - 1) for i in range(points)]
        over = tail_frequency(rated, grid).where(F.col("tail") > ratio * F.col("mean"))
        first = over.agg(F.min("factor").alias("f")).first()["f"]
        if first is None:
            return hi
        if first <= lo:
            return lo
        hi = first
        lo = grid[grid.index(first) - 1] if first in grid else lo
        if hi - lo < EDGE * 1e-3:
            break
    return (lo + hi) / 2


def loadings(factor: float) -> dict[str, float]:
    """Loading of each insured peril at a calibrated factor."""
    return {k: min(v * factor, A.LOADING_CAP) for k, v in A.BASE_LOADING.items()}
