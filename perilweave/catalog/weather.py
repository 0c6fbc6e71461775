"""Weather series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import weather as W
from .base import load_input, query, sql


def daily(spark, sf):
    return load_input(spark, sf, "daily")


def rounded(df, digits=6):
    return df.select(
        *[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


ANNUAL = """r AS (SELECT *, sum(coalesce(rain, 0)) OVER (PARTITION BY point_id ORDER BY day ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS rain5 FROM daily),
    ann AS (SELECT point_id, CAST(year(day) AS INT) AS year, count(*) FILTER (gust >= 70) AS storm_days, max(gust) AS max_gust, max(rain5) AS rain5d,
      coalesce(sum(CASE WHEN month(day) BETWEEN 6 AND 8 THEN rain END), 0) AS jja_rain,
      avg(CASE WHEN month(day) BETWEEN 6 AND 8 THEN tmax END) AS jja_tmax FROM r GROUP BY 1, 2)"""
INDEX = ANNUAL + """,
    nrm AS (SELECT point_id, avg(CASE WHEN year BETWEEN 1991 AND 2020 THEN jja_rain END) AS normal FROM ann GROUP BY point_id),
    idx AS (SELECT year, avg(storm_days) AS storm_days, avg(max_gust) AS max_gust, avg(rain5d) AS rain5d,
      avg(normal - jja_rain) AS jja_deficit, avg(jja_tmax) AS jja_tmax FROM ann JOIN nrm USING (point_id) GROUP BY year)"""


@query("w2_rolling_sum_centred", sql("daily", """
    SELECT point_id, CAST(day AS VARCHAR) AS day, sum(coalesce(rain, 0)) OVER (PARTITION BY point_id ORDER BY day ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS rain5 FROM daily"""))
def rolling(spark, sf):
    out = W.rolling_sum_centred(daily(spark, sf), "rain", "rain5")
    return out.select("point_id", F.col("day").cast("string").alias("day"), "rain5")


@query("g10_annual_reduce", sql("daily", ANNUAL + """
    SELECT point_id, year, storm_days, round(max_gust, 9) AS max_gust, round(rain5d, 9) AS rain5d, round(jja_rain, 9) AS jja_rain, round(jja_tmax, 9) AS jja_tmax FROM ann"""))
def annual(spark, sf):
    # nine digits: a mean may lie exactly between two values of six
    return rounded(W.annual_reduce(daily(spark, sf)), 9)


@query("g11_baseline_normal", sql("daily", INDEX + """
    SELECT point_id, round(normal, 6) AS normal FROM nrm"""))
def normal(spark, sf):
    return rounded(W.baseline_normal(W.annual_reduce(daily(spark, sf))))


NATIONAL = """SELECT year, round(storm_days, 6) AS storm_days, round(max_gust, 6) AS max_gust, round(rain5d, 6) AS rain5d,
    round(jja_deficit, 6) AS jja_deficit, round(jja_tmax, 6) AS jja_tmax FROM idx"""


@query("g12_national_index", sql("daily", INDEX + NATIONAL))
def national(spark, sf):
    a = W.annual_reduce(daily(spark, sf))
    return rounded(W.national_index(a, W.baseline_normal(a)))


@query("s17_backtest_index", sql("daily", INDEX + """, l AS (
      SELECT year, 'storm_days' AS metric, storm_days AS value FROM idx UNION ALL SELECT year, 'rain5d', rain5d FROM idx
      UNION ALL SELECT year, 'jja_deficit', jja_deficit FROM idx),
    rk AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, year) AS place FROM l)
    SELECT year, max(round(storm_days, 6)) AS storm_days, max(round(jja_deficit, 6)) AS jja_deficit,
      CAST(sum(CASE WHEN place <= 3 THEN 1 ELSE 0 END) AS BIGINT) AS times_top3 FROM idx JOIN rk USING (year) GROUP BY year"""))
def backtest(spark, sf):
    idx = W.backtest_index(daily(spark, sf))
    top = W.top_years(idx, ["storm_days", "rain5d", "jja_deficit"]).groupBy("year").agg(F.count("*").alias("times_top3"))
    out = idx.select("year", "storm_days", "jja_deficit").join(top, "year", "left").fillna(0, ["times_top3"])
    return rounded(out)


@query("t5_top_years_by_metric", sql("daily", INDEX + """, l AS (
      SELECT year, 'storm_days' AS metric, storm_days AS value FROM idx UNION ALL SELECT year, 'rain5d', rain5d FROM idx
      UNION ALL SELECT year, 'jja_deficit', jja_deficit FROM idx),
    rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY metric ORDER BY value DESC, year) AS INT) AS place FROM l)
    SELECT metric, place, year, round(value, 6) AS value FROM rk WHERE place <= 3"""))
def top(spark, sf):
    return rounded(W.top_years(W.backtest_index(daily(spark, sf)), ["storm_days", "rain5d", "jja_deficit"]))


@query("g13_annual_maxima_p98", sql("daily", """
    SELECT point_id, CAST(count(DISTINCT year(day)) AS BIGINT) AS years, round(max(gust), 6) AS top_gust, round(quantile_cont(gust, 98e-2), 6) AS gust_p98 FROM daily GROUP BY point_id"""))
def maxima(spark, sf):
    d = daily(spark, sf)
    m = W.annual_maxima(d).groupBy("point_id").agg(F.count("*").alias("years"), F.max("gust").alias("top_gust"))
    return rounded(m.join(W.daily_percentile(d), "point_id"))


@query("g14_gumbel_moments", sql("daily", """
    m AS (SELECT point_id, year(day) AS y, max(gust) AS g FROM daily GROUP BY 1, 2)
    SELECT point_id, round(avg(g) + stddev_samp(g) * sqrt(6) / pi() * (-ln(-ln(1 - 2e-2)) - 5772156649015329e-16), 6) AS rp_moments FROM m GROUP BY point_id"""))
def moments(spark, sf):
    return rounded(W.gumbel_moments(W.annual_maxima(daily(spark, sf))))


def _newton(steps: int) -> str:
    out = """m AS (SELECT point_id, year(day) AS y, max(gust) AS g FROM daily GROUP BY 1, 2),
    c AS (SELECT point_id, g - avg(g) OVER (PARTITION BY point_id) AS x, avg(g) OVER (PARTITION BY point_id) AS m FROM m),
    b0 AS (SELECT point_id, stddev_samp(x) * sqrt(6) / pi() AS b FROM c GROUP BY point_id)"""
    for i in range(steps):
        out += f""",
    s{i} AS (SELECT c.point_id, max(b) AS b, sum(exp(-x / b)) AS s0, sum(x * exp(-x / b)) AS s1, sum(x * x * exp(-x / b)) AS s2
      FROM c JOIN b{i} USING (point_id) GROUP BY c.point_id),
    b{i + 1} AS (SELECT point_id, b - (b + s1 / s0) / (1 + (s2 / s0 - pow(s1 / s0, 2)) / (b * b)) AS b FROM s{i})"""
    return out + f""",
    z AS (SELECT c.point_id, max(m) AS m, max(b) AS b, avg(exp(-x / b)) AS e FROM c JOIN b{steps} USING (point_id) GROUP BY c.point_id)"""


RP = "round(m - b * ln(e) - b * ln(-ln(1 - 2e-2)), 6)"


@query("g14_gumbel_return_level", sql("daily", _newton(10) + f" SELECT point_id, {RP} AS rp50 FROM z"))
def return_level(spark, sf):
    return rounded(W.gumbel_return_level(W.annual_maxima(daily(spark, sf)), out="rp50"))


@query("s18_gust_climatology", sql("daily", _newton(10) + f""",
    p AS (SELECT point_id, round(quantile_cont(gust, 98e-2), 6) AS gust_p98 FROM daily GROUP BY point_id)
    SELECT z.point_id, gust_p98, {RP} AS gust_rp50 FROM z JOIN p ON z.point_id = p.point_id"""))
def climatology(spark, sf):
    return rounded(W.gust_climatology(daily(spark, sf)))
