"""Premiums, groups and the rating table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import assumptions as A


def price(df: DataFrame, el: str = "el_total", euler: str = "tvar99_euler", el_year: str = "el_year") -> DataFrame:
    """Technical premium: expected loss plus the cost of allocated capital."""
    capital = A.COST_OF_CAPITAL * F.greatest(F.col(euler) - F.col(el_year), F.lit(0.0))
    return df.withColumns({"capital": capital, "premium": F.col(el) + capital})


def reprice(present: DataFrame, future: DataFrame, covered: DataFrame, key: str = "district_id") -> DataFrame:
    """Paired climate repricing: future premium and uplift where a future is mapped.

    Both frames come from the same draws and the same calibration, so only the
    hazard differs. Outside coverage the uplift is NULL.
    """
    cols = ("el_total", "capital", "premium")
    fut = future.select(key, *[F.col(c).alias(f"{c}_cc") for c in cols])
    out = present.join(fut, key).join(covered.select(key, "covered"), key)
    change = 100 * (F.col("premium_cc") / F.greatest("premium", F.lit(1e-9)) - 1)
    return out.withColumns(
        {"cc_covered": F.col("covered").cast("int"), "cc_uplift_pct": F.when(F.col("covered"), change)}
    ).drop("covered")


def repricing_summary(repriced: DataFrame) -> DataFrame:
    """One row: exposure-weighted change over covered districts and its range."""
    kept = repriced.where("cc_covered = 1")
    mean = lambda c: F.sum(F.col(c) * F.col("households"))
    return kept.agg(
        F.count(F.lit(1)).alias("covered"),
        (100 * (mean("premium_cc") / mean("premium") - 1)).alias("uplift_pct"),
        F.min("cc_uplift_pct").alias("least"), F.max("cc_uplift_pct").alias("most"),
    )


def dependence_report(
    dependent: DataFrame, independent: DataFrame, n_districts: int, n_years: int, replicates: int = 120
) -> DataFrame:
    """One row: joint claims and pooled tail uplift of a year-loss table against an independent one."""
    from ..operators import tail as T
    from ..operators.ordering import as_scalar

    joint = lambda y: T.joint_peril_probability(y, n_districts, n_years).select("probability").scalar()
    years = [T.district_years(y) for y in (dependent, independent)]
    ranked = T.ranked_runs(*years)
    pooled = as_scalar(T.pooled_tail(ranked, n_districts * n_years))
    ci = T.bootstrap_ci(*years, n_districts * n_years, replicates, ranked=ranked)
    a, b = joint(dependent), joint(independent)
    return ci.select(
        a.alias("multi_peril_vine"), b.alias("multi_peril_indep"), F.try_divide(a, b).alias("multi_peril_ratio"),
        pooled["dep"].alias("tvar99_vine"), pooled["ind"].alias("tvar99_indep"),
        (100 * (pooled["dep"] / pooled["ind"] - 1)).alias("tvar_uplift_pct"),
        "ci_low", "ci_high",
    )
