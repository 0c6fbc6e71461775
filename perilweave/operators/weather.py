"""Daily weather series reduced to yearly drivers and extreme-value statistics.

Input is one row per (point_id, day) with NULL for missing readings. A point
has one row per day, so its window stays small however many points there are.
"""

from __future__ import annotations

from math import log, pi, sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

# Gust that makes a storm day (km/h), normal period, summer months.
STORM_GUST = 70.0
NORMAL_YEARS = (1991, 2020)
SUMMER = (6, 8)
EULER_MASCHERONI = 0.5772156649015329


def rolling_sum_centred(daily: DataFrame, value: str, out: str, reach: int = 2) -> DataFrame:
    """Sum over neighbouring rows of the series; missing counts as 0, years do not cut it."""
    w = Window.partitionBy("point_id").orderBy("day").rowsBetween(-reach, reach)
    return daily.withColumn(out, F.sum(F.coalesce(F.col(value), F.lit(0.0))).over(w))


def annual_reduce(daily: DataFrame) -> DataFrame:
    """Yearly drivers of one point."""
    summer = F.month("day").between(*SUMMER)
    return (
        rolling_sum_centred(daily, "rain", "rain5")
        .groupBy("point_id", F.year("day").alias("year"))
        .agg(
            F.count_if(F.col("gust") >= STORM_GUST).alias("storm_days"),
            F.max("gust").alias("max_gust"),
            F.max("rain5").alias("rain5d"),
            F.coalesce(F.sum(F.when(summer, F.col("rain"))), F.lit(0.0)).alias("jja_rain"),
            F.avg(F.when(summer, F.col("tmax"))).alias("jja_tmax"),
        )
    )


def baseline_normal(annual: DataFrame, years: tuple[int, int] = NORMAL_YEARS) -> DataFrame:
    """Mean summer rain of each point over the normal period."""
    return annual.groupBy("point_id").agg(
        F.avg(F.when(F.col("year").between(*years), F.col("jja_rain"))).alias("normal")
    )


def national_index(annual: DataFrame, normal: DataFrame) -> DataFrame:
    """Mean of the points per year; rain as a shortfall against each point's own normal."""
    return (
        annual.join(normal, "point_id")
        .groupBy("year")
        .agg(
            F.avg("storm_days").alias("storm_days"),
            F.avg("max_gust").alias("max_gust"),
            F.avg("rain5d").alias("rain5d"),
            F.avg(F.col("normal") - F.col("jja_rain")).alias("jja_deficit"),
            F.avg("jja_tmax").alias("jja_tmax"),
        )
    )


def backtest_index(daily: DataFrame, years: tuple[int, int] = NORMAL_YEARS) -> DataFrame:
    annual = annual_reduce(daily)
    return national_index(annual, baseline_normal(annual, years))


def annual_maxima(daily: DataFrame) -> DataFrame:
    return daily.where("gust IS NOT NULL").groupBy("point_id", F.year("day").alias("year")).agg(
        F.max("gust").alias("gust")
    )


def daily_percentile(daily: DataFrame, q: float = 0.98, out: str = "gust_p98") -> DataFrame:
    """Interpolated percentile of a point's daily gusts."""
    return daily.groupBy("point_id").agg(F.percentile("gust", F.lit(q)).alias(out))


def gumbel_moments(maxima: DataFrame, period: float = 50.0, out: str = "rp_moments") -> DataFrame:
    """Return level from mean and spread, the closed form."""
    reduced = -log(-log(1 - 1 / period))
    scale = F.stddev_samp("gust") * sqrt(6) / pi
    return maxima.groupBy("point_id").agg(
        (F.avg("gust") + scale * (reduced - EULER_MASCHERONI)).alias(out)
    )


def gumbel_return_level(maxima: DataFrame, period: float = 50.0, steps: int = 12, out: str = "rp") -> DataFrame:
    """Return level of a maximum-likelihood Gumbel fit.

    The scale solves b = mean - sum(x e^(-x/b)) / sum(e^(-x/b)) by Newton from
    the moment estimate. A point brings one value per year. Maxima that are all
    equal have no scale: their level is NaN (NULL for a single year).
    """
    x, spread = F.col("x"), F.stddev_samp("gust")
    per_point = maxima.groupBy("point_id").agg(
        F.collect_list("gust").alias("raw"),
        F.avg("gust").alias("m"),
        (F.when(spread == 0, F.lit(float("nan"))).otherwise(spread) * sqrt(6) / pi).alias("b0"),
    )
    # centred values keep the exponentials in range
    per_point = per_point.withColumn("x", F.transform("raw", lambda v: v - F.col("m")))

    def moment(b, power):
        return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + F.pow(v, F.lit(float(power))) * F.exp(-v / b))

    for _ in range(steps):
        per_point = per_point.withColumns(
            {f"s{i}": moment(F.col("b0"), i) for i in (0, 1, 2)}
        ).withColumn(
            "b0",
            F.col("b0")
            - F.expr("b0 + s1 / s0") / F.expr("1 + (s2 / s0 - pow(s1 / s0, 2)) / (b0 * b0)"),
        )
    location = F.col("m") - F.col("b0") * F.log(moment(F.col("b0"), 0) / F.size("x"))
    level = location - F.col("b0") * log(-log(1 - 1 / period))
    return per_point.select("point_id", level.alias(out))


def gust_climatology(daily: DataFrame, period: float = 50.0) -> DataFrame:
    return daily_percentile(daily).join(
        gumbel_return_level(annual_maxima(daily), period, out="gust_rp50"), "point_id"
    )


def top_years(index: DataFrame, metrics: list[str], n: int = 3) -> DataFrame:
    """The n highest years on each metric, from one pass over the index."""
    long = index.select(
        "year", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
    )
    w = Window.partitionBy("metric").orderBy(F.desc("value"), F.asc("year"))
    return long.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
