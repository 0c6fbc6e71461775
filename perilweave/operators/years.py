"""Portfolio view of simulated years: totals, worst years, buckets, exceedance."""

from __future__ import annotations

from math import log10

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .ordering import running

# Share of years below and above each bucket, mildest first.
BUCKETS = (("good", 0.0, 0.5), ("typical", 0.5, 0.9), ("bad", 0.9, 0.99), ("catastrophic", 0.99, 1.0))
PERILS = ("sub", "wx", "fl", "gw")


def with_all_years(years: DataFrame, n_years: int, year: str = "year_id") -> DataFrame:
    """Years without any loss are years too: add them with zeros."""
    spark = years.sparkSession
    every = spark.range(n_years).withColumnRenamed("id", year)
    numeric = [c for c in years.columns if c != year]
    return every.join(years, year, "left").fillna(0.0, numeric)


def portfolio_years(
    ylt: DataFrame, exposure: DataFrame, key: str = "district_id", year: str = "year_id",
    perils=PERILS, n_years: int | None = None,
) -> DataFrame:
    """Exposure-weighted loss and claiming exposure per year and peril.

    Only one row per year leaves the map side; totals are rounded before any
    ranking, so the order of addition cannot move a year.
    """
    weighted = ylt.where("loss > 0").join(exposure.select(key, "households"), key)
    loss = [
        F.round(F.sum(F.when(F.col("peril") == p, F.col("loss") * F.col("households")).otherwise(0.0)), 4).alias(f"loss_{p}")
        for p in perils
    ]
    hit = [
        F.sum(F.when(F.col("peril") == p, F.col("households")).otherwise(0.0)).alias(f"hit_{p}")
        for p in perils
    ]
    years = weighted.groupBy(year).agg(*loss, *hit)
    return with_all_years(years, n_years, year) if n_years else years


def worst_years(years: DataFrame, total: str, year: str, k: int) -> DataFrame:
    """The k years with the largest total; the earlier year on ties."""
    return years.orderBy(F.desc(total), F.asc(year)).limit(k).select(year, total)


def exceedance_points(years: DataFrame, total: str, year: str, n_years: int) -> DataFrame:
    """Every year with its return period n / rank."""
    ranked = running(years, total, year, descending=True, rank="_rank")
    return ranked.select(
        F.col("_rank").alias("rank"),
        (F.lit(float(n_years)) / F.col("_rank")).alias("period"),
        F.col(total).alias("loss"),
    )


def exceedance_ranks(n_years: int, points: int = 140) -> list[int]:
    """Ranks spread evenly on a log scale from 1 to half the years."""
    top = log10(n_years / 2)
    return sorted({round(10 ** (top * i / (points - 1))) for i in range(points)})


def exceedance_curve(years: DataFrame, total: str, year: str, n_years: int, points: int = 140) -> DataFrame:
    """Return period and loss at the selected ranks."""
    ranks = exceedance_ranks(n_years, points)
    curve = exceedance_points(years, total, year, n_years)
    return curve.where(F.col("rank").isin(*ranks))


def bucket_of(rank: Column, n_years: int) -> Column:
    out = F.lit(None).cast("string")
    for label, lo, hi in BUCKETS[::-1]:
        out = F.when((rank > int(lo * n_years)) & (rank <= int(hi * n_years)), label).otherwise(out)
    return out


def bucket_summary(
    years: DataFrame, exposure_total: Column, n_years: int, indep: str, year: str = "year_id", perils=PERILS
) -> DataFrame:
    """Mean cost, peril mix and incidence of good to catastrophic years.

    ``years`` has loss_* and hit_* per peril and the total ``indep`` of the
    independent run, which is bucketed by its own ranking.
    """
    total = sum((F.col(f"loss_{p}") for p in perils), F.lit(0.0))
    base = years.withColumn("_total", F.round(total, 4))
    ranked = running(base, "_total", year, rank="_r").withColumn("bucket", bucket_of(F.col("_r"), n_years))
    other = running(base.select(year, indep), indep, year, rank="_r").withColumn(
        "bucket", bucket_of(F.col("_r"), n_years)
    )
    per = lambda c: F.avg(c) / exposure_total
    own = ranked.groupBy("bucket").agg(
        per("_total").alias("mean_total"),
        *[per(f"loss_{p}").alias(f"mean_{p}") for p in perils],
        *[(100 * per(f"hit_{p}")).alias(f"inc_{p}_pct") for p in perils],
    )
    ind = other.groupBy("bucket").agg(per(indep).alias("indep_mean_total"))
    typical = Window.partitionBy(F.lit(1))
    return own.join(ind, "bucket").withColumn(
        "extra_vs_typical",
        F.round("mean_total", 1)
        - F.max(F.when(F.col("bucket") == "typical", F.round("mean_total", 1))).over(typical),
    )


def worst_year(years: DataFrame, exposure_total: Column, year: str = "year_id", perils=PERILS) -> DataFrame:
    """Breakdown of the single worst year."""
    total = F.round(sum((F.col(f"loss_{p}") for p in perils), F.lit(0.0)), 4)
    top = years.agg(
        F.max_by(
            F.struct(F.col(year), total.alias("total"), *[c for p in perils for c in (F.col(f"loss_{p}"), F.col(f"hit_{p}"))]),
            F.struct(total, -F.col(year)),
        ).alias("w")
    ).select("w.*")
    return top.select(
        year,
        (F.col("total") / exposure_total).alias("total"),
        *[(F.col(f"loss_{p}") / exposure_total).alias(p) for p in perils],
        *[(100 * F.col(f"hit_{p}") / exposure_total).alias(f"inc_{p}_pct") for p in perils],
    )
