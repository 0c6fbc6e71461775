"""Lookups with fallbacks, merges and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookup as L
from .base import load_input, query, sql

# Fractions known for labelled documents only: real gaps for the fallbacks.
FRACTIONS = """SELECT doc_id, quality * 5e-1 + ((doc_id * 37) % 101) / 202e0 AS f_high,
    quality * 5e-1 + ((doc_id * 37) % 101) / 202e0 + toxic * 25e-2 AS f_low FROM {labels}"""
FRAC = f"f AS ({FRACTIONS.format(labels='labels')})"


def fractions(spark, sf):
    return spark.sql(FRACTIONS, labels=load_input(spark, sf, "labels"))


def places(spark, sf):
    return load_input(spark, sf, "documents").select("doc_id", "lang", "n_chars")


@query("j1_lookup_or_median", f"""WITH {FRAC},
    m AS (SELECT quantile_cont(f.f_high, 5e-1) AS mh, quantile_cont(f.f_low, 5e-1) AS ml FROM documents JOIN f USING (doc_id))
    SELECT d.doc_id, round(coalesce(f.f_high, mh), 4) AS f_high, round(coalesce(f.f_low, ml), 4) AS f_low
    FROM documents d CROSS JOIN m LEFT JOIN f ON d.doc_id = f.doc_id""")
def median(spark, sf):
    out = L.lookup_or_median(places(spark, sf), fractions(spark, sf), "doc_id", ["f_high", "f_low"])
    return out.select("doc_id", F.round("f_high", 4).alias("f_high"), F.round("f_low", 4).alias("f_low"))


@query("j2_lookup_or_const", f"""WITH {FRAC}
    SELECT d.doc_id, round(coalesce(f_high, 2e-2), 4) AS f_high FROM documents d LEFT JOIN f ON d.doc_id = f.doc_id""")
def const(spark, sf):
    out = L.lookup_or_const(places(spark, sf), fractions(spark, sf), "doc_id", "f_high", 0.02)
    return out.select("doc_id", F.round("f_high", 4).alias("f_high"))


@query("j3_lookup_or_zero", f"""WITH {FRAC}
    SELECT d.doc_id, round(coalesce(f_high, 0), 4) AS f_high, round(coalesce(f_low, 0), 4) AS f_low,
      0e0 AS f_unmapped FROM documents d LEFT JOIN f ON d.doc_id = f.doc_id""")
def zero(spark, sf):
    out = L.lookup_or_zero(
        places(spark, sf), fractions(spark, sf), "doc_id", ["f_high", "f_low", "f_unmapped"]
    )
    return out.select(
        "doc_id", F.round("f_high", 4).alias("f_high"), F.round("f_low", 4).alias("f_low"), "f_unmapped"
    )


@query("j4_lookup_or_percentile", f"""WITH {FRAC}, h AS (SELECT doc_id, 10 * f_low AS households FROM f),
    m AS (SELECT quantile_cont(households, 1e-1) AS low FROM documents JOIN h USING (doc_id))
    SELECT d.doc_id, round(greatest(coalesce(households, low), 1e0), 4) AS households
    FROM documents d CROSS JOIN m LEFT JOIN h ON d.doc_id = h.doc_id""")
def percentile(spark, sf):
    h = fractions(spark, sf).select("doc_id", (10 * F.col("f_low")).alias("households"))
    out = L.lookup_or_percentile(places(spark, sf), h, "doc_id", "households")
    return out.select("doc_id", F.round("households", 4).alias("households"))


APPORTION = """m AS (SELECT l_orderkey, l_suppkey FROM lineitem),
    t AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'P'),
    sz AS (SELECT l_orderkey, count(*) AS n FROM m GROUP BY l_orderkey),
    p AS (SELECT count(*) AS pool FROM m LEFT JOIN t ON l_orderkey = o_orderkey WHERE o_orderkey IS NULL AND l_orderkey >= 1000)"""


@query("j11_apportion", f"""WITH {APPORTION}
    SELECT l_suppkey AS district_id,
      round(sum(CASE WHEN o_totalprice IS NOT NULL THEN o_totalprice / n WHEN m.l_orderkey >= 1000 THEN 25e5 / pool ELSE 0 END), 2) AS households,
      count(*) AS members, CAST(sum(CASE WHEN o_totalprice IS NULL AND m.l_orderkey < 1000 THEN 1 ELSE 0 END) AS BIGINT) AS unmatched
    FROM m JOIN sz ON m.l_orderkey = sz.l_orderkey LEFT JOIN t ON m.l_orderkey = o_orderkey CROSS JOIN p GROUP BY l_suppkey""")
def apportion(spark, sf):
    members = load_input(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("small_area"), F.col("l_suppkey").alias("district_id")
    )
    totals = load_input(spark, sf, "orders").where("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("small_area"), F.col("o_totalprice").alias("households")
    )
    out = L.apportion(
        members, totals, "small_area", "district_id", "households",
        pooled=F.col("small_area") >= 1000, pooled_total=2_500_000.0,
    )
    return out.withColumn("households", F.round("households", 2))


# Present and future extents of a district from its open and closed lines.
EXTENTS = """SELECT l_suppkey AS district_id,
    avg(CASE WHEN l_linestatus = 'F' THEN l_discount END) * 5 AS f_high,
    avg(CASE WHEN l_linestatus = 'F' THEN l_tax END) * 5 + 1e-1 AS f_low,
    avg(CASE WHEN l_linestatus = 'O' THEN l_discount END) * 5 AS c_high,
    avg(CASE WHEN l_linestatus = 'O' THEN l_tax END) * 5 + 1e-1 AS c_low FROM {lineitem} GROUP BY l_suppkey"""
EXT = f"x AS ({EXTENTS.format(lineitem='lineitem')})"


# The same means from whole millionths and one division, so that neither the order of the lines nor the engine moves
# a mean across the threshold, past an equal one, or off a half: high S / 200000 n, low (S + 20000 n) / 200000 n.
_WHOLE = "CAST(round({v} * 1e6) AS BIGINT)"
_MEAN = ("CAST(sum(CASE WHEN l_linestatus = '{s}' THEN " + _WHOLE + " + {add} END) AS DOUBLE)"
    " / nullif(200000e0 * count(CASE WHEN l_linestatus = '{s}' THEN {v} END), 0e0) AS {name}")  # fmt: skip
EXACT_EXTENTS = "SELECT l_suppkey AS district_id, " + ", ".join(
    _MEAN.format(s=s, v=v, add=add, name=f"{p}_{band}")
    for p, s in (("f", "F"), ("c", "O")) for band, v, add in (("high", "l_discount", 0), ("low", "l_tax", 20000))
) + " FROM {lineitem} GROUP BY l_suppkey"
EXACT_EXT = f"x AS ({EXACT_EXTENTS.format(lineitem='lineitem')})"


def half_up(value: str) -> str:
    """Oracle text: four decimals, halves away from zero whatever the binary value of the half."""
    return f"CAST(round(CAST({value} AS DECIMAL(18, 9)), 4) AS DOUBLE)"


def extents(spark, sf, text=EXTENTS):
    return spark.sql(text, lineitem=load_input(spark, sf, "lineitem"))


@query("j13_override_where_covered", sql("country", f"""{EXACT_EXT},
    j AS (SELECT x.*, coalesce(country = 'EUROPE' AND share >= 95e-2, FALSE) AS covered FROM x LEFT JOIN country c ON x.district_id = c.district_id),
    k AS (SELECT district_id, covered, CASE WHEN covered AND c_high >= 25e-2 THEN c_high ELSE f_high END AS h,
       CASE WHEN covered AND c_high >= 25e-2 THEN c_low ELSE f_low END AS l FROM j)
    SELECT district_id, covered, {half_up("h")} AS f_high, {half_up("greatest(l, h)")} AS f_low FROM k"""))
def override(spark, sf):
    x = extents(spark, sf, EXACT_EXTENTS).join(load_input(spark, sf, "country"), "district_id", "left")
    x = x.withColumn("covered", F.coalesce(F.expr("country = 'EUROPE' AND share >= 95e-2"), F.lit(False)))
    future = extents(spark, sf, EXACT_EXTENTS).where("c_high >= 25e-2").selectExpr("district_id", "c_high AS f_high", "c_low AS f_low")
    out = L.override_where_covered(x, future, "district_id", ["f_high", "f_low"], "covered")
    return out.select(
        "district_id", "covered", F.round("f_high", 4).alias("f_high"),
        F.round(F.greatest("f_low", "f_high"), 4).alias("f_low"),
    )


@query("j14_max_merge", f"""WITH {EXACT_EXT}, p AS (SELECT * FROM x WHERE c_high >= 25e-2)
    SELECT x.district_id, {half_up("greatest(x.f_high, coalesce(p.c_high, x.f_high))")} AS f_high,
      {half_up("greatest(x.f_low, coalesce(p.c_low, x.f_low), x.f_high, coalesce(p.c_high, x.f_high))")} AS f_low,
      coalesce(p.c_high > x.f_high, FALSE) AS f_high_upgraded, coalesce(p.c_low > x.f_low, FALSE) AS f_low_upgraded
    FROM x LEFT JOIN p ON x.district_id = p.district_id""")
def merge(spark, sf):
    base = extents(spark, sf, EXACT_EXTENTS).select("district_id", "f_high", "f_low")
    patch = extents(spark, sf, EXACT_EXTENTS).where("c_high >= 25e-2").selectExpr("district_id", "c_high AS f_high", "c_low AS f_low")
    out = L.max_merge(base, patch, "district_id", ["f_high", "f_low"], nest=("f_low", "f_high"))
    return out.withColumns({c: F.round(c, 4) for c in ("f_high", "f_low")})


@query("k7_upsert_by_region", f"""WITH {EXT}, old AS (
      SELECT district_id, 'england' AS region, f_high, f_low FROM x UNION ALL SELECT district_id, 'wales', f_high / 2, f_low / 2 FROM x),
    fresh AS (SELECT district_id, 'wales' AS region, c_high AS f_high, c_low AS f_low FROM x),
    u AS (SELECT * FROM old WHERE region <> 'wales' UNION ALL SELECT * FROM fresh)
    SELECT district_id, round(least(greatest(sum(f_high), 0), 1), 4) AS f_high, round(least(greatest(sum(f_low), 0), 1), 4) AS f_low
    FROM u GROUP BY district_id""")
def upsert(spark, sf):
    x = extents(spark, sf)
    old = x.selectExpr("district_id", "'england' AS region", "f_high", "f_low").unionByName(
        x.selectExpr("district_id", "'wales' AS region", "f_high / 2 AS f_high", "f_low / 2 AS f_low")
    )
    fresh = x.selectExpr("district_id", "'wales' AS region", "c_high AS f_high", "c_low AS f_low")
    out = L.upsert_by_region(old, fresh, "district_id", "region", ["f_high", "f_low"])
    return out.withColumns({c: F.round(c, 4) for c in ("f_high", "f_low")})


GROUPED = """WITH a AS (SELECT c_custkey, CAST(1 + floor(c_acctbal / 1000) AS INT) AS g FROM customer),
    b AS (SELECT o_custkey AS c_custkey, CAST(1 + floor(max(o_totalprice) / 60000) AS INT) AS g FROM orders GROUP BY o_custkey)"""


@query("j16_compare_groups", GROUPED + """
    SELECT round(100 * avg(CASE WHEN a.g <> b.g THEN 1e0 ELSE 0e0 END), 4) AS churn_pct, count(*) AS compared FROM a JOIN b USING (c_custkey)""")
def churn(spark, sf):
    a = load_input(spark, sf, "customer").selectExpr("c_custkey", "CAST(1 + floor(c_acctbal / 1000) AS INT) AS g")
    b = load_input(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.expr("CAST(1 + floor(max(o_totalprice) / 60000) AS INT)").alias("g")
    )
    return L.compare_groups(a, b, "c_custkey", "g").withColumn("churn_pct", F.round("churn_pct", 4))


@query("j18_diff_results", """WITH a AS (SELECT o_custkey AS k, round(sum(o_totalprice), 2) AS total, count(*) * 1e0 AS n FROM orders GROUP BY 1),
    b AS (SELECT o_custkey AS k, round(sum(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice ELSE 0 END), 2) AS total, count(*) * 1e0 AS n
          FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1),
    j AS (SELECT a.k AS ak, b.k AS bk, a.total AS ta, b.total AS tb, a.n AS na, b.n AS nb FROM a FULL JOIN b ON a.k = b.k),
    m AS (SELECT count(*) AS miss FROM j WHERE ak IS NULL OR bk IS NULL)
    SELECT 'total' AS "column", max(miss) AS missing_keys, count(*) FILTER (ta IS DISTINCT FROM tb) AS differing, round(max(abs(ta - tb)), 2) AS max_abs_diff
      FROM j CROSS JOIN m WHERE ak IS NOT NULL AND bk IS NOT NULL
    UNION ALL SELECT 'n', max(miss), count(*) FILTER (na IS DISTINCT FROM nb), round(max(abs(na - nb)), 2)
      FROM j CROSS JOIN m WHERE ak IS NOT NULL AND bk IS NOT NULL""")
def diff(spark, sf):
    o = load_input(spark, sf, "orders")
    a = o.groupBy(F.col("o_custkey").alias("k")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("n")
    )
    b = o.where("o_orderpriority <> '1-URGENT'").groupBy(F.col("o_custkey").alias("k")).agg(
        F.round(F.sum(F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).otherwise(0.0)), 2).alias("total"),
        F.count("*").alias("n"),
    )
    return L.diff_results(a, b, "k", ["total", "n"]).withColumn("max_abs_diff", F.round("max_abs_diff", 2))


@query("j19_label_or_default", """SELECT s_suppkey AS district_id,
    coalesce(r.r_name, concat('postcode area ', CAST(s_nationkey AS VARCHAR))) AS place
    FROM supplier LEFT JOIN region r ON s_nationkey = r.r_regionkey""")
def labels(spark, sf):
    d = load_input(spark, sf, "supplier").selectExpr("s_suppkey AS district_id", "s_nationkey AS area")
    names = load_input(spark, sf, "region").selectExpr("r_regionkey AS area", "r_name AS place")
    out = L.label_or_default(
        d, names, "area", "place", F.concat(F.lit("postcode area "), F.col("area").cast("string"))
    )
    return out.select("district_id", "place")


@query("j20_nearest_return_period", sql("ylt", """
    y AS (SELECT year_id, round(sum(loss), 4) AS loss FROM ylt GROUP BY year_id),
    c AS (SELECT 1000e0 / row_number() OVER (ORDER BY loss DESC, year_id) AS period, loss FROM y),
    w AS (SELECT unnest([10e0, 33e0, 100e0, 250e0]) AS wanted),
    r AS (SELECT wanted, period, loss, row_number() OVER (PARTITION BY wanted ORDER BY abs(log10(period) - log10(wanted)), period DESC) AS rn
          FROM w CROSS JOIN c WHERE period BETWEEN 2 AND 1000)
    SELECT wanted, round(period, 4) AS period, round(loss, 2) AS loss FROM r WHERE rn = 1"""))
def return_period(spark, sf):
    from ..operators.years import exceedance_points

    y = load_input(spark, sf, "ylt").groupBy("year_id").agg(F.round(F.sum("loss"), 4).alias("loss"))
    curve = exceedance_points(y, "loss", "year_id", 1000)
    out = L.nearest_return_period(curve, [10, 33, 100, 250])
    return out.select("wanted", F.round("period", 4).alias("period"), F.round("loss", 2).alias("loss"))


@query("u1_union_of_files", """SELECT kind, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM (
    SELECT 'customer' AS kind, c_custkey AS id FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier
    UNION ALL SELECT 'part', p_partkey FROM part) x GROUP BY kind""")
def union(spark, sf):
    one = lambda t, key: load_input(spark, sf, t).select(F.lit(t).alias("kind"), F.col(key).alias("id"))
    whole = one("customer", "c_custkey").unionByName(one("supplier", "s_suppkey")).unionByName(one("part", "p_partkey"))
    return whole.groupBy("kind").agg(
        F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")
    )


@query("u3_vocabulary_except", """SELECT DISTINCT upper(split_part(p_name, ' ', 2)) AS term FROM part
    WHERE upper(split_part(p_name, ' ', 2)) NOT IN ('RING', 'WIDGET')""")
def vocabulary(spark, sf):
    from ..functions.rules import terms_outside

    words = load_input(spark, sf, "part").select(F.split("p_name", " ")[1].alias("term"))
    return terms_outside(words, "term", ["RING", "WIDGET"])


@query("u4_coverage_union", """SELECT tile_id, count(*) AS covered FROM (
    SELECT l_suppkey AS tile_id, l_orderkey % 30 AS px_row, l_partkey % 30 AS px_col FROM lineitem WHERE l_returnflag = 'R'
    UNION SELECT l_suppkey, l_orderkey % 30, l_partkey % 30 FROM lineitem WHERE l_linestatus = 'O') x GROUP BY tile_id""")
def coverage(spark, sf):
    from ..operators.raster import mask_union

    px = load_input(spark, sf, "lineitem").selectExpr(
        "l_suppkey AS tile_id", "l_orderkey % 30 AS px_row", "l_partkey % 30 AS px_col",
        "l_returnflag = 'R' OR l_linestatus = 'O' AS painted",
    )
    return mask_union(px, "painted").groupBy("tile_id").agg(F.count("*").alias("covered"))
