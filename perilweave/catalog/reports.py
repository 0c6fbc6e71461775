"""Published tables, top lists and headline figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordering as O
from ..operators import report as R
from ..operators import years as Y
from .base import YEARS, load_input, query, sql
from .rating import PRICED, _side, priced, published
from .spatial import OVERLAY, DZ, overlay_scored
from .tail import portfolio, r4, summary, whole, ylt

YE = ["ylt", "exposure"]


def table(spark, sf):
    """Names, scores and prices of a supplied year-loss table."""
    s = load_input(spark, sf, "scored")
    p = priced(spark, sf).withColumn("premium", F.round("premium", 4))
    return O.decile_group(s.join(p, "district_id"), "premium", "district_id").withColumn(
        "uplift_pct", F.expr("100 * (tvar99 - euler) / greatest(euler, 1e-9)")
    )


TABLE = PRICED + """,
    rt AS (SELECT s.*, pr.* EXCLUDE (district_id, households, premium), round(premium, 4) AS premium,
      CAST(greatest(1, ceil((row_number() OVER (ORDER BY round(premium, 4), s.district_id) - 1) * 10e0 / greatest(count(*) OVER () - 1, 1))) AS INT) AS grp
      FROM scored s JOIN pr ON s.district_id = pr.district_id)"""
TI = ["ylt", "exposure", "scored"]


@query("k1_publish_rounded", sql(TI, TABLE + """
    SELECT name, area, round_even(sub_score, 4) AS sub_score, round_even(households, 0) AS households, round_even(el_sub, 1) AS el_sub, round_even(el_total, 1) AS el_total,
      round_even(er_frac, 7) AS er_frac, round_even(capital, 4) AS capital, round_even(premium, 1) AS premium, grp AS "group" FROM rt"""))
def rounded(spark, sf):
    cols = ("name", "area", "sub_score", "households", "el_sub", "el_total", "er_frac", "capital", "premium", "group")
    return R.publish_rounded(table(spark, sf).select(*cols))


@query("k2_fill_undefined", sql(["ylt_present", "ylt_future", "exposure", "country"], _side("ylt_present") + ",\n" + _side("ylt_future") + """
    SELECT a.district_id, CAST(coalesce(country = 'EUROPE' AND share >= 95e-2, FALSE) AS INT) AS cc_covered,
      CASE WHEN coalesce(country = 'EUROPE' AND share >= 95e-2, FALSE) THEN round(100 * (b.premium / greatest(a.premium, 1e-9) - 1), 4) ELSE 0e0 END AS cc_uplift_pct
    FROM p_ylt_present a JOIN p_ylt_future b ON a.district_id = b.district_id JOIN country c ON a.district_id = c.district_id"""))
def filled(spark, sf):
    return r4(published(spark, sf).select("district_id", "cc_covered", "cc_uplift_pct"))


@query("k4_export_table_csv", sql(TI, TABLE + """
    SELECT name, area, CAST(CAST(round_even(premium, 0) AS BIGINT) AS VARCHAR) AS premium, CAST(grp AS VARCHAR) AS "group", '' AS geol, '' AS cc_covered FROM rt"""))
def export(spark, sf):
    t = table(spark, sf).withColumn("premium", F.bround("premium", 0).cast("long"))
    return R.export_table(t).select("name", "area", "premium", "group", "geol", "cc_covered")


@query("k5_export_lookup", sql(TI, TABLE + """
    SELECT name AS n, grp AS g, CAST(round_even(premium, 0) AS BIGINT) AS p, CAST(round_even(el_sub, 0) AS BIGINT) AS es, CAST(round_even(capital, 0) AS BIGINT) AS c,
      round_even(sub_score, 2) AS s, round_even(fl_score, 2) AS f FROM rt"""))
def lookup(spark, sf):
    return R.export_lookup(table(spark, sf)).select("n", "g", "p", "es", "c", "s", "f")


@query("k6_year_summary")
def year_summary(spark, sf):
    from ..sources.sinks import year_summary_json

    years = portfolio(spark, sf).withColumn("total", F.round(F.expr("loss_sub + loss_wx + loss_fl + loss_gw"), 4))
    curve = Y.exceedance_curve(years, "total", "year_id", YEARS)
    return year_summary_json(summary(spark, sf), curve, Y.worst_year(portfolio(spark, sf), whole(spark, sf)))


@query("s9_loss_drivers", sql(TI, TABLE + """,
    l AS (SELECT district_id, el_total, unnest([el_fl, el_sub, el_wx, el_gw]) AS v, unnest(['flood', 'subsidence', 'weather', 'groundwater']) AS n, unnest([1, 2, 3, 4]) AS o,
      el_fl + el_sub + el_wx + el_gw AS t FROM rt),
    r AS (SELECT *, v / CASE WHEN t = 0 THEN 1 ELSE t END AS sh, row_number() OVER (PARTITION BY district_id ORDER BY v DESC, o) AS rn FROM l),
    k AS (SELECT * FROM r WHERE sh >= 18e-2 OR (rn = 1)),
    g AS (SELECT district_id, count(*) AS n, string_agg(n, ' + ' ORDER BY rn) FILTER (rn <= 3) AS names,
      max(CASE WHEN rn = 1 THEN CAST(CAST(round_even(100 * sh, 0) AS INT) AS VARCHAR) END) AS a, max(CASE WHEN rn = 2 THEN CAST(CAST(round_even(100 * sh, 0) AS INT) AS VARCHAR) END) AS b FROM k GROUP BY district_id)
    SELECT district_id, concat(upper(left(names, 1)), substr(names, 2), CASE WHEN n = 1 THEN concat('-dominated (', a, '% of E[loss])') ELSE concat(' (', a, '% / ', b, '%)') END) AS driver FROM g"""))
def drivers(spark, sf):
    return R.loss_drivers(table(spark, sf)).select("district_id", "driver")


@query("t1_top_premium", sql(TI, TABLE + " SELECT district_id, name, premium FROM rt ORDER BY premium DESC, district_id LIMIT 8"))
def top(spark, sf):
    return R.top_by(table(spark, sf), "premium", 8, "district_id").select("district_id", "name", "premium")


@query("t2_top_with_place", sql(TI, TABLE + """
    SELECT rt.district_id, coalesce(r_name, concat('postcode area ', area)) AS place, premium FROM rt LEFT JOIN region ON area = concat('A', CAST(r_regionkey AS VARCHAR)) ORDER BY premium DESC, rt.district_id LIMIT 6"""))
def top_place(spark, sf):
    from ..operators.lookup import label_or_default

    best = R.loss_drivers(R.top_by(table(spark, sf), "premium", 6, "district_id"))
    names = load_input(spark, sf, "region").selectExpr("concat('A', CAST(r_regionkey AS STRING)) AS area", "r_name AS place")
    out = label_or_default(best, names, "area", "place", F.concat(F.lit("postcode area "), F.col("area")))
    return out.select("district_id", "place", "premium")


@query("t3_top_share", """SELECT c_nationkey AS district_id, round(count(*) FILTER (c_mktsegment = 'BUILDING') * 1e0 / count(*), 5) AS gw_frac
    FROM customer GROUP BY c_nationkey ORDER BY 2 DESC, 1 LIMIT 10""")
def top_share(spark, sf):
    from ..plans.exposure import flag_share

    c = load_input(spark, sf, "customer").selectExpr("c_nationkey AS district_id", "c_mktsegment AS flag")
    return R.top_by(flag_share(c, "district_id", "flag", "building"), "gw_frac", 10, "district_id").select("district_id", "gw_frac")


@query("t4_top_exposed", sql(DZ, OVERLAY + """
    SELECT district_id, round(sum(overlap), 3) AS exposed FROM ov JOIN zone_corners USING (zone_id) WHERE kind = 'LARGE' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12"""))
def top_exposed(spark, sf):
    x = overlay_scored(spark, sf).where("kind = 'LARGE'").groupBy("district_id").agg(F.round(F.sum("overlap"), 3).alias("exposed"))
    return R.top_by(x, "exposed", 12, "district_id")


@query("t6_prefix_search", """SELECT DISTINCT p_name FROM part WHERE starts_with(upper(p_name), 'RED') ORDER BY upper(p_name) = 'RED' DESC, length(p_name), p_name LIMIT 12""")
def search(spark, sf):
    return R.prefix_search(load_input(spark, sf, "part").select("p_name").distinct(), "p_name", " red")


MEASURES = ["sub_score", "wx_score", "fl_score", "gw_score"]


@query("g31_describe", sql("scored", "SELECT * FROM (" + " UNION ALL ".join(f"""
    SELECT '{c}' AS measure, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS spread, round(min({c}), 6) AS least, round(max({c}), 6) AS most,
      round(quantile_cont({c}, 25e-2), 6) AS q25, round(quantile_cont({c}, 5e-1), 6) AS q50, round(quantile_cont({c}, 75e-2), 6) AS q75 FROM scored""" for c in MEASURES) + ") x"))
def describe(spark, sf):
    found = R.describe(load_input(spark, sf, "scored"), MEASURES)
    return found.select("measure", "n", *[F.round(c, 6).alias(c) for c in found.columns[2:]])


@query("g32_headline_stats", sql(["ylt_present", "ylt_future", "exposure", "country", "scored"], _side("ylt_present") + ",\n" + _side("ylt_future") + """,
    j AS (SELECT s.*, a.premium, a.el, b.premium AS premium_cc, greatest(er_frac - 1e-2, 0) AS er_smp105, coalesce(country = 'EUROPE' AND share >= 95e-2, FALSE) AS cov
      FROM scored s JOIN p_ylt_present a ON s.district_id = a.district_id JOIN p_ylt_future b ON s.district_id = b.district_id JOIN country c ON s.district_id = c.district_id)
    SELECT count(*) AS districts, sum(households) AS households, round(min(premium), 4) AS premium_min, round(max(premium), 4) AS premium_max, round(avg(el), 4) AS mean_el,
      round(100 * sum(el * households) / sum(premium * households), 4) AS el_share_pct, round(100 * sum((premium - el) * households) / sum(premium * households), 4) AS capital_share_pct,
      count(*) FILTER (er_nfi105 > 0) AS erosion_exposed, count(*) FILTER (er_nfi105 > 0 AND er_smp105 = 0) AS erosion_saved,
      arg_max(name, er_smp105) AS erosion_worst, count(*) FILTER (cov) AS cc_districts,
      round(100 * (sum(CASE WHEN cov THEN premium_cc * households END) / sum(CASE WHEN cov THEN premium * households END) - 1), 4) AS cc_uplift_pct,
      arg_max(name, premium_cc / premium) FILTER (cov) AS cc_worst FROM j"""))
def headline(spark, sf):
    out = R.headline_stats(published(spark, sf))
    keep = ("districts", "households", "premium_min", "premium_max", "mean_el", "el_share_pct", "capital_share_pct",
            "erosion_exposed", "erosion_saved", "erosion_worst", "cc_districts", "cc_uplift_pct", "cc_worst")
    return r4(out.select(*keep), "premium_min", "premium_max", "mean_el", "el_share_pct", "capital_share_pct", "cc_uplift_pct")


@query("g33_net_change", sql("country", """x AS (SELECT l_suppkey AS district_id, avg(CASE WHEN l_linestatus = 'F' THEN l_discount END) AS p, avg(CASE WHEN l_linestatus = 'O' THEN l_discount END) AS f FROM lineitem GROUP BY 1)
    SELECT round(sum(f) / sum(p), 8) AS growth, count(*) FILTER (f < p - 1e-9) AS shrank, count(*) AS covered FROM x JOIN country c ON x.district_id = c.district_id WHERE country = 'EUROPE'"""))
def change(spark, sf):
    x = load_input(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("district_id")).agg(
        F.avg(F.when(F.col("l_linestatus") == "F", F.col("l_discount"))).alias("p"),
        F.avg(F.when(F.col("l_linestatus") == "O", F.col("l_discount"))).alias("f"),
    )
    out = R.net_change(x.join(load_input(spark, sf, "country"), "district_id"), "p", "f", F.col("country") == "EUROPE")
    return out.withColumn("growth", F.round("growth", 8))


@query("s19_exposure_by_district", """WITH pc AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN concat('cf', CAST(c_nationkey AS VARCHAR), ' 1aa') ELSE concat('sw', CAST(c_nationkey AS VARCHAR), '2bb') END AS postcode,
      concat(CASE c_mktsegment WHEN 'BUILDING' THEN 'E' WHEN 'MACHINERY' THEN 'W' WHEN 'HOUSEHOLD' THEN 'S' WHEN 'FURNITURE' THEN 'N' ELSE '' END, CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN '' ELSE CAST(c_custkey % 50 AS VARCHAR) END) AS area FROM customer),
    ce AS (SELECT left(a, 1) AS n, a AS area, h FROM (SELECT concat(CASE WHEN o_custkey % 3 = 0 THEN 'E' WHEN o_custkey % 3 = 1 THEN 'W' ELSE 'X' END, CAST(o_custkey % 50 AS VARCHAR)) AS a, count(*) * 1e0 AS h FROM orders GROUP BY 1) k),
    live AS (SELECT upper(CASE WHEN contains(postcode, ' ') THEN split_part(postcode, ' ', 1) ELSE left(postcode, length(postcode) - 3) END) AS name, area FROM pc WHERE area <> '' AND left(area, 1) <> 'N'),
    sz AS (SELECT area, count(*) AS sz FROM live GROUP BY area), pool AS (SELECT count(*) AS p FROM live LEFT JOIN ce ON live.area = ce.area WHERE ce.area IS NULL AND left(live.area, 1) = 'S')
    SELECT name, round(sum(CASE WHEN h IS NOT NULL THEN h / sz WHEN left(live.area, 1) = 'S' THEN 5000e0 / p ELSE 0 END), 4) AS households, count(*) AS postcodes,
      CAST(sum(CASE WHEN h IS NULL AND left(live.area, 1) <> 'S' THEN 1 ELSE 0 END) AS BIGINT) AS unmatched
    FROM live JOIN sz ON live.area = sz.area LEFT JOIN ce ON live.area = ce.area CROSS JOIN pool GROUP BY name""")
def exposure_table(spark, sf):
    from ..plans.exposure import exposure_by_district

    pc = load_input(spark, sf, "customer").selectExpr(
        """CASE WHEN c_custkey % 2 = 0 THEN concat('cf', CAST(c_nationkey AS STRING), ' 1aa') ELSE concat('sw', CAST(c_nationkey AS STRING), '2bb') END AS postcode""",
        """concat(CASE c_mktsegment WHEN 'BUILDING' THEN 'E' WHEN 'MACHINERY' THEN 'W' WHEN 'HOUSEHOLD' THEN 'S' WHEN 'FURNITURE' THEN 'N' ELSE '' END,
            CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN '' ELSE CAST(c_custkey % 50 AS STRING) END) AS area""",
    )
    census = load_input(spark, sf, "orders").selectExpr(
        "concat(CASE WHEN o_custkey % 3 = 0 THEN 'E' WHEN o_custkey % 3 = 1 THEN 'W' ELSE 'X' END, CAST(o_custkey % 50 AS STRING)) AS area"
    ).groupBy("area").agg(F.count("*").cast("double").alias("households"))
    return r4(exposure_by_district(pc, census, "S", 5000.0))
