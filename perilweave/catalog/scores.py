"""Hazard score queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import spatial as S
from ..plans import scores as P
from ..plans.calibrate import weighted_mean
from .base import INPUTS, area_expr, load_input, overlap_cte, query, sql
from .base import rings as as_rings
from .rules import CLOSED, NAMES, ROCKS
from .spatial import CELL, KNN, OVERLAY, centres, districts, zones

INPUTS["drift_corners"] = """
    SELECT drift_id AS zone_id, lex_d, cx - r AS x1, cy - 3e-1 * r AS y1, cx + 2e-1 * r AS x2, cy - r AS y2,
      cx + r AS x3, cy + 4e-1 * r AS y3, cx - 1e-1 * r AS x4, cy + 9e-1 * r AS y4 FROM (
      SELECT c_custkey AS drift_id, c_mktsegment AS lex_d, 8e0 * (c_custkey % 150) AS cx,
        75e-1 * floor(c_custkey / 150e0) AS cy, 20173e-4 + c_custkey % 3 AS r FROM {customer}) k"""
DRIFT = {"BUILDING": 0.75, "AUTOMOBILE": 0.05, "MACHINERY": 0.45, "HOUSEHOLD": 0.3}


def scored(spark, sf):
    return load_input(spark, sf, "scored")


def r4(df, *cols):
    return df.withColumns({c: F.round(c, 4) for c in cols})


@query("g7_weighted_mean", sql("scored", """
    SELECT area, round(sum(fl_score * households) / sum(households), 6) AS fl, round(sum(sub_score * households) / sum(households), 6) AS sub FROM scored GROUP BY area"""))
def mean(spark, sf):
    return scored(spark, sf).groupBy("area").agg(
        F.round(weighted_mean("fl_score", "households"), 6).alias("fl"),
        F.round(weighted_mean("sub_score", "households"), 6).alias("sub"),
    )


@query("g8_percentile_scale", sql("scored", """
    q AS (SELECT quantile_cont(sub_score, 5e-2) AS a, quantile_cont(sub_score, 95e-2) AS b, quantile_cont(households, 5e-2) AS c, quantile_cont(households, 95e-2) AS d FROM scored)
    SELECT district_id, round(least(greatest((sub_score - a) / (b - a), 0), 1), 4) AS sub_score, round(least(greatest((households - c) / (d - c), 0), 1), 4) AS households FROM scored CROSS JOIN q"""))
def stretch(spark, sf):
    out = P.percentile_scale(scored(spark, sf).select("district_id", "sub_score", "households"), ["sub_score", "households"])
    return r4(out, "sub_score", "households")


@query("g9_sqrt_anchor", sql("scored", """
    q AS (SELECT greatest(quantile_cont(er_frac, 995e-3), 1e-9) AS a FROM scored)
    SELECT district_id, round(least(sqrt(er_frac / a), 1), 4) AS score FROM scored CROSS JOIN q"""))
def anchor(spark, sf):
    return r4(P.sqrt_anchor(scored(spark, sf), "er_frac", 0.995, "score", 1e-9).select("district_id", "score"), "score")


FLOOD = """i AS (SELECT district_id, households, 75e-2 * f_high + 25e-2 * f_low + 6e-1 * (75e-2 * sw_high + 25e-2 * sw_low) AS i FROM scored),
    a AS (SELECT greatest(quantile_cont(i, 95e-2), 1e-6) AS a FROM i)"""


@query("s3_flood_score", sql("scored", FLOOD + " SELECT district_id, round(least(sqrt(i / a), 1), 4) AS fl_score FROM i CROSS JOIN a"))
def flood(spark, sf):
    return r4(P.flood_score(scored(spark, sf).drop("fl_score")).select("district_id", "fl_score"), "fl_score")


UNIT = """SELECT s_suppkey AS district_id, count(*) AS n_postcodes, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS n_possible
    FROM {supplier} JOIN {customer} ON s_nationkey = c_nationkey GROUP BY s_suppkey"""


@query("g4_flag_share", """SELECT c_nationkey AS district_id, round(count(*) FILTER (lower(trim(c_mktsegment)) = 'building') * 1e0 / count(*), 5) AS gw_frac,
    count(*) AS n_postcodes FROM customer GROUP BY c_nationkey""")
def share(spark, sf):
    from ..plans.exposure import flag_share

    c = load_input(spark, sf, "customer").selectExpr("c_nationkey AS district_id", "c_mktsegment AS flag")
    return flag_share(c, "district_id", "flag", "building")


@query("s4_groundwater_score", sql("scored", """
    t AS (SELECT c_nationkey AS k, round(count(*) FILTER (c_mktsegment = 'BUILDING') * 1e0 / count(*), 5) AS g FROM customer WHERE c_acctbal < 9000 AND c_nationkey <> 7 GROUP BY 1),
    f AS (SELECT s_suppkey AS district_id, coalesce(g, 2e-2) AS gw_frac FROM supplier LEFT JOIN t ON s_nationkey = k),
    a AS (SELECT greatest(quantile_cont(gw_frac, 97e-2), 1e-6) AS a FROM f)
    SELECT district_id, round(gw_frac, 5) AS gw_frac, round(least(sqrt(gw_frac / a), 1), 4) AS gw_score FROM f CROSS JOIN a"""))
def groundwater(spark, sf):
    from ..plans.exposure import flag_share

    c = load_input(spark, sf, "customer").where("c_acctbal < 9000 AND c_nationkey <> 7")
    table = flag_share(c.selectExpr("c_nationkey AS area", "c_mktsegment AS flag"), "area", "flag", "building")
    d = load_input(spark, sf, "supplier").selectExpr("s_suppkey AS district_id", "s_nationkey AS area")
    return r4(P.groundwater_score(d, table, "area").select("district_id", "gw_frac", "gw_score"), "gw_score")


@query("s5_erosion_score", sql(["scored", "country"], """
    e AS (SELECT s.district_id, CASE WHEN country = 'EUROPE' THEN er_frac ELSE 0e0 END AS smp, CASE WHEN country = 'EUROPE' THEN er_nfi105 ELSE 0e0 END AS nfi
      FROM scored s JOIN country c ON s.district_id = c.district_id),
    a AS (SELECT greatest(quantile_cont(smp, 995e-3), 1e-9) AS a FROM e)
    SELECT district_id, round(smp, 7) AS er_smp105, round(nfi, 7) AS er_nfi105, 0e0 AS er_gi, round(least(sqrt(smp / a), 1), 4) AS er_score FROM e CROSS JOIN a"""))
def erosion(spark, sf):
    s = scored(spark, sf)
    mapped = s.join(load_input(spark, sf, "country").where("country = 'EUROPE'"), "district_id").selectExpr(
        "district_id", "er_frac AS er_smp105", "er_nfi105"
    )
    out = P.erosion_score(s.select("district_id"), mapped)
    return out.select(
        "district_id", F.round("er_smp105", 7).alias("er_smp105"), F.round("er_nfi105", 7).alias("er_nfi105"),
        "er_gi", F.round("er_score", 4).alias("er_score"),
    )


# Depth masks: fractions of the envelopes, one missing district in seven countries' worth.
DEPTH = """SELECT s.district_id, """ + ", ".join(
    f"sw_{b} * {f} AS {k}_{b}" for b in ("high", "low") for k, f in
    (("d02", "8e-1"), ("d03", "6e-1"), ("d06", "(3e-1 + gw_frac / 2)"), ("d09", "gw_frac / 2"), ("d12", "(gw_frac / 4)"))
) + """ FROM {scored} s WHERE wx_score > 2e-1"""
DEPTH_SQL = """x AS (SELECT s.*, coalesce(country = 'EUROPE' AND share >= 95e-2, FALSE) AS covered FROM scored s JOIN country c ON s.district_id = c.district_id),
    dp AS (""" + DEPTH.replace("{scored}", "scored") + """),
    e AS (SELECT x.*, """ + ", ".join(f"coalesce({k}_{b}, 0) AS {k}_{b}" for k in P.DEPTH_KEYS for b in ("high", "low")) + """ FROM x LEFT JOIN dp ON x.district_id = dp.district_id),
    m AS (SELECT *, """ + ", ".join(
    f"greatest({', '.join([f'sw_{b}'] * (i == 0) + [f'{k}_{b}' for k in P.DEPTH_KEYS[max(i - 1, 0):]])}, 0) AS {b[0]}e{i}"
    for b in ("high", "low") for i in range(6)
) + """ FROM e),
    b AS (SELECT *, """ + ", ".join(
    [f"{b}e{i}" + (f" - {b}e{i + 1}" if i < 5 else "") + f" AS {b}b{i}" for b in "hl" for i in range(6)]
) + """ FROM m),
    f AS (SELECT *, """ + ", ".join(f"greatest(lb{i} - hb{i}, 0) AS fb{i}" for i in range(6)) + """ FROM b),
    g AS (SELECT *, 1e-2 * (""" + " + ".join(f"hb{i}" for i in range(6)) + ") AS wh, 2e-3 * (" + " + ".join(f"fb{i}" for i in range(6)) + """) AS wf FROM f),
    h AS (SELECT *, """ + ", ".join(f"(1e-2 * hb{i} + 2e-3 * fb{i}) / greatest(wh + wf, 1e-15) AS s{i}" for i in range(6)) + """ FROM g),
    r AS (SELECT *, """ + " + ".join(f"s{i}" for i in range(6)) + """ AS tot FROM h),
    q AS (SELECT *, CASE WHEN covered AND tot > 1e-9 THEN (45e-2 * s0 + 75e-2 * s1 + s2 + 135e-2 * s3 + 16e-1 * s4 + 195e-2 * s5) / tot END AS mult,
      CASE WHEN covered AND tot > 1e-9 THEN (1e-1 * s0 + 25e-2 * s1 + 45e-2 * s2 + 75e-2 * s3 + 105e-2 * s4 + 15e-1 * s5) / tot END AS depth FROM r),
    ref AS (SELECT coalesce(sum(mult * households) / sum(CASE WHEN mult IS NOT NULL THEN households END), 1) AS ref FROM q)"""


def depth_inputs(spark, sf):
    s = scored(spark, sf).drop("sw_sev").join(load_input(spark, sf, "country"), "district_id")
    s = s.withColumn("covered", R.coverage_mask(F.col("country"), F.col("share"), "EUROPE"))
    return s, spark.sql(DEPTH, scored=scored(spark, sf))


@query("s6_depth_severity", sql(["scored", "country"], DEPTH_SQL + """
    SELECT district_id, round(coalesce(mult / ref, 1), 4) AS sw_sev, round(depth, 4) AS sw_depth_m FROM q CROSS JOIN ref"""))
def depth(spark, sf):
    d, bands = depth_inputs(spark, sf)
    out = P.depth_severity(d, bands)
    return r4(out.select("district_id", "sw_sev", "sw_depth_m"), "sw_sev", "sw_depth_m")


@query("w3_running_max_reverse", sql(["scored", "country"], DEPTH_SQL + """
    SELECT district_id, """ + ", ".join(f"round(he{i}, 6) AS e{i}" for i in range(6)) + " FROM m"))
def running_max(spark, sf):
    d, bands = depth_inputs(spark, sf)
    names = [f"{k}_high" for k in P.DEPTH_KEYS]
    joined = d.join(bands.select("district_id", *names), "district_id", "left").fillna(0.0, names)
    edges = P.running_max_reverse(["sw_high", *names])
    return joined.select("district_id", *[F.round(e, 6).alias(f"e{i}") for i, e in enumerate(edges)])


@query("w4_band_shares", sql(["scored", "country"], DEPTH_SQL + """
    SELECT district_id, """ + ", ".join(f"round(hb{i}, 6) AS b{i}" for i in range(6)) + " FROM b"))
def shares(spark, sf):
    d, bands = depth_inputs(spark, sf)
    names = [f"{k}_high" for k in P.DEPTH_KEYS]
    joined = d.join(bands.select("district_id", *names), "district_id", "left").fillna(0.0, names)
    out = P.band_shares(joined, "sw_high", names, "b")
    return out.select("district_id", *[F.round(f"b{i}", 6).alias(f"b{i}") for i in range(6)])


W5 = {"wind": "3e-1", "wdr": "25e-2", "gust_rp50": "2e-1", "rain10": "15e-2", "precip": "1e-1"}


@query("s2_weather_score", sql(["district_corners", "grid"], KNN + """,
    v AS (SELECT nn.district_id, """ + ", ".join(f"sum({c} / pow(greatest(d, 1), 2)) / sum(1 / pow(greatest(d, 1), 2)) AS {c}" for c in W5) + """
      FROM nn JOIN grid g ON nn.point_id = g.point_id WHERE rn <= 4 GROUP BY nn.district_id),
    q AS (SELECT """ + ", ".join(f"quantile_cont({c}, 5e-2) AS {c}_lo, quantile_cont({c}, 95e-2) AS {c}_hi" for c in W5) + """ FROM v)
    SELECT district_id, round(wind, 4) AS wind, round(gust_rp50, 4) AS gust_rp50, round(""" + " + ".join(
    f"{w} * least(greatest(({c} - {c}_lo) / ({c}_hi - {c}_lo), 0), 1)" for c, w in W5.items()) + """, 4) AS wx_score FROM v CROSS JOIN q"""))
def weather(spark, sf):
    g = load_input(spark, sf, "grid")
    out = P.weather_score(centres(spark, sf), [(g, ["wind", "wdr", "rain10", "precip", "gust_rp50"])])
    return r4(out.select("district_id", "wind", "gust_rp50", "wx_score"), "wind", "gust_rp50", "wx_score")


DRIFT_OV = overlap_cte("dv", "district_corners", "drift_corners", "district_id", "zone_id")
SUSC = """CASE WHEN contains(upper(p_name), 'RED') THEN 1e0 WHEN contains(upper(p_name), 'SMALL') THEN 9e-1 WHEN contains(upper(p_name), 'BLUE') THEN 55e-2
    WHEN contains(upper(p_type), 'PROMO') THEN 7e-1 * f WHEN contains(upper(p_type), 'STANDARD') THEN 4e-1 * f WHEN contains(upper(p_type), 'LARGE') THEN 25e-2 * f ELSE 8e-2 END"""


@query("s1_subsidence_score", sql(["district_corners", "zone_corners", "drift_corners"], OVERLAY + ", " + DRIFT_OV + f""",
    rock AS (SELECT p_partkey AS zone_id, p_name, {SUSC} AS susc FROM (SELECT *, CASE WHEN upper(p_brand) IN ('BRAND#1', 'BRAND#2', 'BRAND#3', 'BRAND#4') THEN 1e0 ELSE 3e-1 END AS f FROM part) x),
    bd AS (SELECT district_id, sum(overlap * susc) / sum(overlap) AS bed FROM ov JOIN rock USING (zone_id) GROUP BY 1),
    bk AS (SELECT district_id, p_name, row_number() OVER (PARTITION BY district_id ORDER BY round(overlap, 6) DESC, zone_id DESC) AS rn FROM ov JOIN rock USING (zone_id) WHERE susc >= 4e-1),
    dk AS (SELECT district_id, zone_id, overlap, lex_d, CASE lex_d WHEN 'BUILDING' THEN 75e-2 WHEN 'AUTOMOBILE' THEN 5e-2 WHEN 'MACHINERY' THEN 45e-2 ELSE 3e-1 END AS susc
      FROM dv JOIN drift_corners USING (zone_id) WHERE lex_d <> 'FURNITURE'),
    ds AS (SELECT district_id, sum(overlap * susc) / sum(overlap) AS sup, sum(overlap) AS cov FROM dk GROUP BY 1),
    dd AS (SELECT district_id, lex_d, row_number() OVER (PARTITION BY district_id ORDER BY round(overlap, 6) DESC, zone_id DESC) AS rn FROM dk),
    j AS (SELECT d.district_id, bed, coalesce(sup, 0) AS sup, least(coalesce(cov, 0) / ({area_expr()}), 1) AS cover, coalesce(bk.p_name, 'none (low-plasticity bedrock)') AS geol,
       coalesce(concat(left(dd.lex_d, 1), lower(substr(dd.lex_d, 2))), 'none mapped') AS sup_geol
      FROM district_corners d JOIN bd ON d.district_id = bd.district_id LEFT JOIN bk ON d.district_id = bk.district_id AND bk.rn = 1
      LEFT JOIN ds ON d.district_id = ds.district_id LEFT JOIN dd ON d.district_id = dd.district_id AND dd.rn = 1)
    SELECT district_id, round((1 - 5e-1 * cover) * bed + 5e-1 * cover * sup, 4) AS sub_score, round(cover, 4) AS sup_frac, geol, sup_geol FROM j"""))
def subsidence(spark, sf):
    part = load_input(spark, sf, "part").selectExpr(
        "p_partkey AS zone_id", "p_name AS lex_d", "p_type AS rcs_d", "p_brand AS max_period"
    )
    susc = R.classify_keywords(
        F.col("lex_d"), F.col("rcs_d"), F.col("max_period"), NAMES, ROCKS, ("BRAND#1", "BRAND#2", "BRAND#3", "BRAND#4")
    )
    bedrock = zones(spark, sf).select("zone_id", "rings").join(part, "zone_id")
    drift = as_rings(load_input(spark, sf, "drift_corners"))
    out = P.subsidence_score(
        districts(spark, sf), bedrock, drift, CELL, susc=susc, known=DRIFT, left_out=("FURNITURE",)
    )
    return r4(out.select("district_id", "sub_score", "sup_frac", "geol", "sup_geol"), "sub_score", "sup_frac")
