"""Projections, filters and classification rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators.ordering import as_scalar
from ..plans import marginals as M
from ..schema import require_columns
from .base import load_input, query, sql

NAMES = (("RED", 1.0), ("SMALL", 0.9), ("BLUE", 0.55))
ROCKS = (("PROMO", 0.7), ("STANDARD", 0.4), ("LARGE", 0.25))


@query("p1_classify_keywords", """SELECT p_partkey AS zone_id, round(CASE
    WHEN contains(upper(p_name), 'RED') THEN 1e0 WHEN contains(upper(p_name), 'SMALL') THEN 9e-1
    WHEN contains(upper(p_name), 'BLUE') THEN 55e-2
    WHEN contains(upper(p_type), 'PROMO') THEN 7e-1 * f WHEN contains(upper(p_type), 'STANDARD') THEN 4e-1 * f
    WHEN contains(upper(p_type), 'LARGE') THEN 25e-2 * f ELSE 8e-2 END, 4) AS susc
    FROM (SELECT *, CASE WHEN upper(trim(p_brand)) IN ('BRAND#1', 'BRAND#2', 'BRAND#3', 'BRAND#4') THEN 1e0 ELSE 3e-1 END AS f FROM part) x""")
def keywords(spark, sf):
    p = load_input(spark, sf, "part")
    susc = R.classify_keywords(
        F.col("p_name"), F.col("p_type"), F.col("p_brand"), NAMES, ROCKS,
        ("BRAND#1", "BRAND#2", "BRAND#3", "BRAND#4"),
    )
    return p.select(F.col("p_partkey").alias("zone_id"), F.round(susc, 4).alias("susc"))


CLOSED = {"ECONOMY": 0.75, "LARGE": 0.7, "MEDIUM": 0.6, "PROMO": 0.5, "SMALL": 0.05}


@query("p2_classify_closed", """SELECT p_partkey AS zone_id, CASE p_type WHEN 'ECONOMY' THEN 75e-2 WHEN 'LARGE' THEN 7e-1
    WHEN 'MEDIUM' THEN 6e-1 WHEN 'PROMO' THEN 5e-1 WHEN 'SMALL' THEN 5e-2 END AS susc FROM part WHERE p_type <> 'STANDARD'""")
def closed(spark, sf):
    p = load_input(spark, sf, "part").withColumn("term", F.lower("p_type"))
    out = R.classify_closed(p, "term", CLOSED, ("STANDARD",))
    return out.select(F.col("p_partkey").alias("zone_id"), "susc")


@query("p3_blend_bounded", sql("scored", """
    SELECT district_id, round(least(greatest((1 - 5e-1 * least(greatest(3 * gw_frac, 0), 1)) * sub_score
      + 5e-1 * least(greatest(3 * gw_frac, 0), 1) * fl_score, 0), 1), 4) AS score FROM scored"""))
def blend(spark, sf):
    out = R.blend_bounded(F.col("sub_score"), F.col("fl_score"), 3 * F.col("gw_frac"))
    return load_input(spark, sf, "scored").select("district_id", F.round(out, 4).alias("score"))


CODES = """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN concat('cf', CAST(c_nationkey AS STRING), ' ', substr(c_name, 17, 3))
    ELSE concat('sw', CAST(c_nationkey AS STRING), substr(c_name, 17, 2)) END AS postcode,
    concat(CASE c_mktsegment WHEN 'BUILDING' THEN 'E' WHEN 'MACHINERY' THEN 'W' WHEN 'HOUSEHOLD' THEN 'S' WHEN 'FURNITURE' THEN 'N' ELSE '' END,
      CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN '' ELSE CAST(c_custkey AS STRING) END) AS code FROM {customer}"""


def codes(spark, sf):
    return spark.sql(CODES, customer=load_input(spark, sf, "customer"))


@query("p4_outward_code", f"""WITH c AS ({CODES.format(customer='customer')})
    SELECT c_custkey, upper(CASE WHEN contains(postcode, ' ') THEN split_part(postcode, ' ', 1)
      ELSE left(postcode, length(postcode) - 3) END) AS outward FROM c""")
def outward(spark, sf):
    return codes(spark, sf).select("c_custkey", R.outward_code(F.col("postcode")).alias("outward"))


@query("p5_filter_code_prefix", f"""WITH c AS ({CODES.format(customer='customer')})
    SELECT left(code, 1) AS nation, count(*) AS n FROM c WHERE code <> '' AND left(code, 1) IN ('E', 'W', 'S') GROUP BY 1""")
def prefix(spark, sf):
    c = codes(spark, sf)
    census = c.where(R.has_code_prefix(F.col("code"), ["E", "W"]))
    other = c.where(R.has_code_prefix(F.col("code"), ["S"]))
    return census.unionByName(other).groupBy(F.substring("code", 1, 1).alias("nation")).agg(F.count("*").alias("n"))


@query("p6_coverage_mask", sql("country", """
    SELECT district_id, country, coalesce(country = 'EUROPE' AND share >= 95e-2, FALSE) AS covered FROM country"""))
def mask(spark, sf):
    covered = R.coverage_mask(F.col("country"), F.col("share"), "EUROPE")
    return load_input(spark, sf, "country").select("district_id", "country", covered.alias("covered"))


@query("p7_enforce_nesting", sql("scored", """
    SELECT district_id, round(least(greatest(sw_low, gw_frac, f_high, er_frac), 1), 4) AS d02, round(least(greatest(gw_frac, f_high, er_frac), 1), 4) AS d03,
      round(least(greatest(f_high, er_frac), 1), 4) AS d06, round(least(greatest(er_frac, 0), 1), 4) AS d09 FROM scored"""))
def nesting(spark, sf):
    s = load_input(spark, sf, "scored").selectExpr(
        "district_id", "sw_low AS d02", "gw_frac AS d03", "f_high AS d06", "er_frac AS d09"
    )
    out = R.enforce_nesting(s, [("d06", "d09"), ("d03", "d06"), ("d02", "d03")])
    return out.select("district_id", *[F.round(c, 4).alias(c) for c in ("d02", "d03", "d06", "d09")])


@query("p14_require_columns", sql("scored", """
    SELECT district_id, round(sub_score, 4) AS sub_score, round(wx_score, 4) AS wx_score, round(households, 1) AS households FROM scored"""))
def contract(spark, sf):
    s = require_columns(load_input(spark, sf, "scored"), ["district_id", "sub_score", "wx_score", "households"])
    return s.select(
        "district_id", F.round("sub_score", 4).alias("sub_score"), F.round("wx_score", 4).alias("wx_score"),
        F.round("households", 1).alias("households"),
    )


FREQ = """p AS (SELECT *, 2e-3 + 28e-3 * pow(sub_score, 15e-1) AS p_sub, 1e-2 + 9e-2 * pow(wx_score, 12e-1) AS p_wx,
      5e-4 + 15e-3 * f_high + 3e-3 * greatest(f_low - f_high, 0) AS p_river,
      1e-2 * sw_high + 2e-3 * greatest(sw_low - sw_high, 0) AS p_surface, 3e-4 + 8e-3 * gw_frac AS p_gw, er_frac / 80 AS p_er FROM scored)"""
MULT = FREQ + """,
    m AS (SELECT 244e6 / 2450e0 / 155e5 / (sum(p_wx * households) / sum(households)) AS k_wx,
      312e6 / 3e4 / 155e5 / (sum((p_river + p_surface) * households) / sum(households)) AS k_fl,
      307e6 / 17820e0 / 155e5 / (sum(p_sub * households) / sum(households)) AS k_sub,
      1e-1 * 312e6 / 3e4 / 155e5 / (sum(p_gw * households) / sum(households)) AS k_gw FROM p)"""


@query("p15_marginal_frequency", sql("scored", MULT + """
    SELECT district_id, round(1e4 * p_sub * k_sub, 4) AS p_sub, round(1e4 * p_wx * k_wx, 4) AS p_wx,
      round(1e4 * (p_river + p_surface) * k_fl, 4) AS p_fl, round(1e4 * p_gw * k_gw, 4) AS p_gw, round(1e4 * p_er, 4) AS p_er
    FROM p CROSS JOIN m"""))
def frequency(spark, sf):
    from ..plans.calibrate import frequency_multipliers

    s = load_input(spark, sf, "scored")
    out = M.marginal_frequency(s, as_scalar(frequency_multipliers(s)))
    return out.select(
        "district_id", *[F.round(1e4 * F.col(f"p_{k}"), 4).alias(f"p_{k}") for k in ("sub", "wx", "fl", "gw", "er")]
    )


@query("p16_marginal_severity", sql("scored", FREQ + """
    SELECT district_id, round(ln(17820e0) - 81e-2 / 2, 4) AS mu_sub, round(ln(2450e0) - 121e-2 / 2, 4) AS mu_wx,
      round((p_river * (ln(35e3) - 81e-2 / 2) + p_surface * (ln(18e3 * sw_sev) - 81e-2 / 2)) / (p_river + p_surface), 4) AS mu_fl,
      round(ln(2e4) - 64e-2 / 2, 4) AS mu_gw, round(ln(25e4) - 1225e-4 / 2, 4) AS mu_er FROM p"""))
def severity(spark, sf):
    out = M.marginal_severity(M.marginal_frequency(load_input(spark, sf, "scored")))
    return out.select("district_id", *[F.round(f"mu_{k}", 4).alias(f"mu_{k}") for k in ("sub", "wx", "fl", "gw", "er")])


@query("p17_pair_strength", sql("scored", """
    t AS (SELECT district_id, least(125e-2 + 125e-2 * sqrt(wx_score * sub_score), 25e-1) AS ts, least(14e-1 + 16e-1 * sqrt(wx_score * fl_score), 3e0) AS tf,
      least(13e-1 + 11e-1 * sqrt(wx_score * gw_score), 24e-1) AS tg, least(135e-2 + 13e-1 * sqrt(wx_score * er_score), 26e-1) AS te FROM scored)
    SELECT district_id, round(ts, 4) AS theta_sub, round(tf, 4) AS theta_fl, round(tg, 4) AS theta_gw, round(te, 4) AS theta_er,
      round(1 - 1 / tf, 4) AS tau_fl, round(2 - pow(2e0, 1 / tf), 4) AS tail_dep_fl, round(2 - pow(2e0, 1 / ts), 4) AS tail_dep_sub FROM t"""))
def strength(spark, sf):
    out = M.pair_strength(load_input(spark, sf, "scored"))
    cols = ("theta_sub", "theta_fl", "theta_gw", "theta_er", "tau_fl", "tail_dep_fl", "tail_dep_sub")
    return out.select("district_id", *[F.round(c, 4).alias(c) for c in cols])


@query("p18_exposure_state", sql(["scored", "country"], """
    SELECT s.district_id, CASE WHEN country <> 'EUROPE' THEN 'not mapped' WHEN er_frac > 25e-3 THEN 'eroding'
      WHEN gw_frac > 2e-1 THEN 'defended' ELSE 'measured zero' END AS state FROM scored s JOIN country c ON s.district_id = c.district_id"""))
def state(spark, sf):
    s = load_input(spark, sf, "scored").join(load_input(spark, sf, "country"), "district_id")
    out = R.exposure_state(
        F.col("country"), F.greatest(F.col("gw_frac") - 0.2, F.lit(0.0)),
        F.greatest(F.col("er_frac") - 0.025, F.lit(0.0)), "EUROPE",
    )
    return s.select("district_id", out.alias("state"))


@query("p13_systematic_sample", """SELECT s_suppkey AS district_id, s_nationkey AS area FROM (
    SELECT *, row_number() OVER (ORDER BY s_suppkey) AS rn FROM supplier) x WHERE (rn - 1) % 3 = 0""")
def sample(spark, sf):
    from ..operators.sampling import systematic_sample

    s = load_input(spark, sf, "supplier").selectExpr("s_suppkey AS district_id", "s_nationkey AS area")
    return systematic_sample(s, "district_id", 3)


@query("f_title_case", """SELECT p_partkey AS zone_id, array_to_string(list_transform(regexp_extract_all(lower(concat(p_type, '-with-', p_name)), '[a-z]+|[^a-z]+'),
    lambda x: concat(upper(left(x, 1)), substr(x, 2))), '') AS label FROM part""")
def title(spark, sf):
    p = load_input(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("zone_id"),
        R.title_case(F.concat("p_type", F.lit("-with-"), "p_name")).alias("label"),
    )
