"""Tail measures, allocation, ranks and year views on a year-loss table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordering as O
from ..operators import tail as T
from ..operators import years as Y
from .base import YEARS, load_input, query, sql
from .sqltext import uniform


def ylt(spark, sf, name="ylt"):
    return load_input(spark, sf, name)


def exposure(spark, sf):
    return load_input(spark, sf, "exposure")


def whole(spark, sf):
    return exposure(spark, sf).agg(F.sum("households").alias("w")).scalar()


def r4(df, *names, digits=4):
    names = names or [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, digits) for c in names})


EL = """el AS (SELECT e.district_id, coalesce(sum(CASE WHEN peril = 'sub' THEN loss END), 0) / 1000 AS el_sub,
      coalesce(sum(CASE WHEN peril = 'wx' THEN loss END), 0) / 1000 AS el_wx, coalesce(sum(CASE WHEN peril = 'fl' THEN loss END), 0) / 1000 AS el_fl,
      coalesce(sum(CASE WHEN peril = 'gw' THEN loss END), 0) / 1000 AS el_gw, coalesce(sum(loss), 0) / 1000 AS el_total
    FROM exposure e LEFT JOIN ylt ON e.district_id = ylt.district_id GROUP BY e.district_id)"""
DY = """dy AS (SELECT district_id, year_id, sum(loss) AS loss FROM ylt WHERE loss > 0 GROUP BY 1, 2)"""
# the dense form: every district-year, zeros included, read off by position
DENSE = DY + """,
    yrs AS (SELECT CAST(range AS BIGINT) AS year_id FROM range(1000)),
    dense AS (SELECT e.district_id, y.year_id, coalesce(dy.loss, 0) AS loss FROM exposure e CROSS JOIN yrs y
      LEFT JOIN dy ON dy.district_id = e.district_id AND dy.year_id = y.year_id),
    rk AS (SELECT *, row_number() OVER (PARTITION BY district_id ORDER BY loss DESC, year_id) AS rn FROM dense),
    tl AS (SELECT district_id, sum(CASE WHEN rn <= 10 THEN loss END) / 10 AS tvar99, quantile_cont(loss, 995e-3) AS var995 FROM rk GROUP BY district_id)"""
PORT = """port AS (SELECT year_id, round(sum(loss * households), 4) AS total FROM dy JOIN exposure USING (district_id) GROUP BY year_id),
    bad AS (SELECT year_id, total FROM port ORDER BY total DESC, year_id LIMIT 10),
    eu AS (SELECT e.district_id, e.households, coalesce(s.euler, 0) AS euler FROM exposure e LEFT JOIN
      (SELECT district_id, sum(loss) / 10 AS euler FROM dy JOIN bad USING (year_id) GROUP BY district_id) s ON e.district_id = s.district_id)"""
YE = ["ylt", "exposure"]


@query("g15_expected_loss", sql(YE, EL + """
    SELECT district_id, round(el_sub, 7) AS el_sub, round(el_wx, 7) AS el_wx, round(el_fl, 7) AS el_fl, round(el_gw, 7) AS el_gw, round(el_total, 7) AS el_total FROM el"""))
def expected(spark, sf):
    return r4(T.expected_loss(ylt(spark, sf), exposure(spark, sf), YEARS), digits=7)


@query("g17_var", sql(YE, DENSE + " SELECT district_id, round(var995, 7) AS var995 FROM tl"))
def var(spark, sf):
    t = T.tail_measures(T.district_years(ylt(spark, sf)), exposure(spark, sf), YEARS)
    return r4(t.select("district_id", "var995"), digits=7)


@query("g18_tvar", sql(YE, DENSE + " SELECT district_id, round(tvar99, 5) AS tvar99 FROM tl"))
def tvar(spark, sf):
    t = T.tail_measures(T.district_years(ylt(spark, sf)), exposure(spark, sf), YEARS)
    return r4(t.select("district_id", "tvar99"), digits=5)


@query("g19_tail_uplift_pct", sql(["ylt", "ylt_indep", "exposure"], DENSE + """,
    di AS (SELECT district_id, year_id, sum(loss) AS loss FROM ylt_indep WHERE loss > 0 GROUP BY 1, 2),
    ri AS (SELECT *, row_number() OVER (PARTITION BY district_id ORDER BY loss DESC, year_id) AS rn FROM di),
    ti AS (SELECT district_id, sum(loss) / 10 AS tvar99 FROM ri WHERE rn <= 10 GROUP BY district_id)
    SELECT tl.district_id, round(100 * (round(tl.tvar99, 6) - round(coalesce(ti.tvar99, 0), 6)) / greatest(round(coalesce(ti.tvar99, 0), 6), 1e-9), 4) AS uplift_pct
    FROM tl LEFT JOIN ti ON tl.district_id = ti.district_id"""))
def uplift(spark, sf):
    e = exposure(spark, sf)
    a = T.tail_measures(T.district_years(ylt(spark, sf)), e, YEARS, names=("dep", "v1"))
    b = T.tail_measures(T.district_years(ylt(spark, sf, "ylt_indep")), e, YEARS, names=("ind", "v2"))
    # Rounded first: on the floor of 1e-9 the last digit of a sum would show.
    out = a.join(b, "district_id").withColumns({c: F.round(c, 6) for c in ("dep", "ind")})
    return out.select("district_id", F.round(T.tail_uplift_pct(F.col("dep"), F.col("ind")), 4).alias("uplift_pct"))


@query("g34_peril_totals", sql(["ylt5", "exposure"], """
    dy AS (SELECT district_id, year_id, sum(CASE WHEN peril <> 'er' THEN loss ELSE 0 END) AS t4, sum(loss) AS t5 FROM ylt5 WHERE loss > 0 GROUP BY 1, 2),
    a AS (SELECT district_id, t4, row_number() OVER (PARTITION BY district_id ORDER BY t4 DESC, year_id) AS rn FROM dy),
    b AS (SELECT district_id, t5, row_number() OVER (PARTITION BY district_id ORDER BY t5 DESC, year_id) AS rn FROM dy)
    SELECT e.district_id, round(coalesce(x.tv, 0), 5) AS tvar99_vine, round(coalesce(y.tv, 0), 5) AS tvar99_vine5 FROM exposure e
      LEFT JOIN (SELECT district_id, sum(t4) / 10 AS tv FROM a WHERE rn <= 10 GROUP BY 1) x ON e.district_id = x.district_id
      LEFT JOIN (SELECT district_id, sum(t5) / 10 AS tv FROM b WHERE rn <= 10 GROUP BY 1) y ON e.district_id = y.district_id"""))
def totals(spark, sf):
    t = T.peril_totals(ylt(spark, sf, "ylt5"))
    e = exposure(spark, sf)
    four = T.tail_measures(t, e, YEARS, "total4", names=("tvar99_vine", "v4"))
    five = T.tail_measures(t, e, YEARS, "total5", names=("tvar99_vine5", "v5"))
    return r4(four.join(five, "district_id").select("district_id", "tvar99_vine", "tvar99_vine5"), digits=5)


PY = """py AS (SELECT year_id, """ + ", ".join(
    f"round(sum(CASE WHEN peril = '{p}' THEN loss * households ELSE 0 END), 4) AS loss_{p}, sum(CASE WHEN peril = '{p}' THEN households ELSE 0 END) AS hit_{p}"
    for p in T.INSURED
) + """ FROM ylt JOIN exposure USING (district_id) WHERE loss > 0 GROUP BY year_id),
    yrs AS (SELECT CAST(range AS BIGINT) AS year_id FROM range(1000)),
    pf AS (SELECT y.year_id, """ + ", ".join(
    f"coalesce(loss_{p}, 0) AS loss_{p}, coalesce(hit_{p}, 0) AS hit_{p}" for p in T.INSURED
) + " FROM yrs y LEFT JOIN py ON y.year_id = py.year_id)"


def portfolio(spark, sf, name="ylt"):
    return Y.portfolio_years(ylt(spark, sf, name), exposure(spark, sf), n_years=YEARS)


@query("g20_portfolio_years", sql(YE, PY + """
    SELECT year_id, """ + ", ".join(f"loss_{p}, hit_{p}" for p in T.INSURED) + " FROM pf"))
def portfolio_query(spark, sf):
    return portfolio(spark, sf)


@query("g21_euler_allocation", sql(YE, ",\n".join([DY, PORT]) + " SELECT district_id, round(euler, 5) AS euler FROM eu"))
def euler(spark, sf):
    return r4(T.euler_allocation(T.district_years(ylt(spark, sf)), exposure(spark, sf), YEARS), digits=5)


@query("g22_tail_concentration", sql(YE, ",\n".join([DY, PORT]) + """,
    c AS (SELECT district_id, round(euler * households, 6) AS cap FROM eu),
    r AS (SELECT cap, row_number() OVER (ORDER BY cap DESC, district_id) AS rn, count(*) OVER () AS n FROM c)
    SELECT round(sum(CASE WHEN rn <= greatest(floor(n / 10), 1) THEN cap END) / sum(cap), 6) AS share,
      CAST(sum(CASE WHEN rn <= greatest(floor(n / 10), 1) THEN 1 ELSE 0 END) AS BIGINT) AS districts FROM r"""))
def concentration(spark, sf):
    e = exposure(spark, sf)
    a = T.euler_allocation(T.district_years(ylt(spark, sf)), e, YEARS).join(e, "district_id")
    return r4(T.tail_concentration(a), digits=6)


@query("g23_diversification_credit", sql(YE, DENSE + ",\n" + PORT + """
    SELECT round(sum(euler * households) / sum(households), 4) AS portfolio, round(sum(tvar99 * households) / sum(households), 4) AS standalone,
      round(1 - sum(euler * households) / sum(tvar99 * households), 6) AS credit FROM eu JOIN tl USING (district_id)"""))
def credit(spark, sf):
    e, dy = exposure(spark, sf), T.district_years(ylt(spark, sf))
    rated = T.euler_allocation(dy, e, YEARS).join(T.tail_measures(dy, e, YEARS), "district_id").join(e, "district_id")
    return r4(T.diversification_credit(rated), "portfolio", "standalone").withColumn("credit", F.round("credit", 6))


TOT = "round(loss_sub + loss_wx + loss_fl + loss_gw, 4)"
BUCKET = """CASE WHEN r <= 500 THEN 'good' WHEN r <= 900 THEN 'typical' WHEN r <= 990 THEN 'bad' ELSE 'catastrophic' END"""
IND = """iy AS (SELECT year_id, round(sum(loss * households), 4) AS total FROM ylt_indep JOIN exposure USING (district_id) WHERE loss > 0 GROUP BY year_id),
    inf AS (SELECT y.year_id, coalesce(total, 0) AS indep FROM yrs y LEFT JOIN iy ON y.year_id = iy.year_id),
    ib AS (SELECT bucket, avg(indep) AS indep FROM (SELECT indep, """ + BUCKET + """ AS bucket FROM
       (SELECT indep, row_number() OVER (ORDER BY indep, year_id) AS r FROM inf) a) b GROUP BY bucket)"""
SUMMARY = PY + ",\n" + IND + f""",
    w AS (SELECT sum(households) AS w FROM exposure),
    b AS (SELECT *, {BUCKET} AS bucket FROM (SELECT *, {TOT} AS total, row_number() OVER (ORDER BY {TOT}, year_id) AS r FROM pf) k),
    g AS (SELECT bucket, avg(total) / max(w) AS mean_total, avg(loss_sub) / max(w) AS mean_sub, avg(loss_wx) / max(w) AS mean_wx,
      avg(loss_fl) / max(w) AS mean_fl, avg(loss_gw) / max(w) AS mean_gw, 100 * avg(hit_sub) / max(w) AS inc_sub_pct, 100 * avg(hit_wx) / max(w) AS inc_wx_pct,
      100 * avg(hit_fl) / max(w) AS inc_fl_pct, 100 * avg(hit_gw) / max(w) AS inc_gw_pct FROM b CROSS JOIN w GROUP BY bucket)"""


def summary(spark, sf):
    ind = Y.with_all_years(
        T.portfolio_total(T.district_years(ylt(spark, sf, "ylt_indep")), exposure(spark, sf)).withColumnRenamed("total", "indep"),
        YEARS,
    )
    years = portfolio(spark, sf).join(ind, "year_id")
    return Y.bucket_summary(years, whole(spark, sf), YEARS, "indep")


@query("g24_bucket_summary", sql(["ylt", "ylt_indep", "exposure"], SUMMARY + """
    SELECT g.bucket, round(mean_total, 4) AS mean_total, round(mean_sub, 4) AS mean_sub, round(mean_wx, 4) AS mean_wx, round(mean_fl, 4) AS mean_fl,
      round(mean_gw, 4) AS mean_gw, round(inc_sub_pct, 4) AS inc_sub_pct, round(inc_wx_pct, 4) AS inc_wx_pct, round(inc_fl_pct, 4) AS inc_fl_pct,
      round(inc_gw_pct, 4) AS inc_gw_pct, round(indep / w, 4) AS indep_mean_total,
      round(round(mean_total, 1) - (SELECT round(mean_total, 1) FROM g WHERE bucket = 'typical'), 1) AS extra_vs_typical
    FROM g JOIN ib ON g.bucket = ib.bucket CROSS JOIN w"""))
def buckets(spark, sf):
    return r4(summary(spark, sf)).withColumn("extra_vs_typical", F.round("extra_vs_typical", 1))


RANKS = ", ".join(str(r) for r in Y.exceedance_ranks(YEARS))


@query("g25_exceedance_curve", sql(YE, PY + f""",
    r AS (SELECT {TOT} AS total, row_number() OVER (ORDER BY {TOT} DESC, year_id) AS rank FROM pf),
    steps AS (SELECT DISTINCT CAST(round_even(pow(10e0, log10(500e0) * range / 139), 0) AS BIGINT) AS rank FROM range(140))
    SELECT rank, round(1000e0 / rank, 4) AS period, round(total, 4) AS loss FROM r WHERE rank IN (SELECT rank FROM steps)"""))
def exceedance(spark, sf):
    total = F.round(F.expr("loss_sub + loss_wx + loss_fl + loss_gw"), 4)
    return r4(Y.exceedance_curve(portfolio(spark, sf).withColumn("total", total), "total", "year_id", YEARS))


@query("g26_worst_year", sql(YE, PY + f""",
    w AS (SELECT sum(households) AS w FROM exposure), t AS (SELECT *, {TOT} AS total FROM pf ORDER BY {TOT} DESC, year_id LIMIT 1)
    SELECT year_id, round(total / w, 4) AS total, round(loss_sub / w, 4) AS sub, round(loss_wx / w, 4) AS wx, round(loss_fl / w, 4) AS fl, round(loss_gw / w, 4) AS gw,
      round(100 * hit_sub / w, 4) AS inc_sub_pct, round(100 * hit_wx / w, 4) AS inc_wx_pct, round(100 * hit_fl / w, 4) AS inc_fl_pct, round(100 * hit_gw / w, 4) AS inc_gw_pct
    FROM t CROSS JOIN w"""))
def worst(spark, sf):
    return r4(Y.worst_year(portfolio(spark, sf), whole(spark, sf)))


JOINT = "(SELECT district_id, year_id FROM {t} WHERE loss > 0 GROUP BY 1, 2 HAVING count(DISTINCT peril) >= 2)"


@query("g27_joint_peril_probability", sql(["ylt", "ylt_indep", "exposure"], f"""
    a AS (SELECT count(*) AS m FROM {JOINT.format(t='ylt')} x), b AS (SELECT count(*) AS m FROM {JOINT.format(t='ylt_indep')} x), n AS (SELECT count(*) * 1000e0 AS n FROM exposure)
    SELECT 'dependent' AS run, a.m AS multi, round(a.m / n, 8) AS probability FROM a CROSS JOIN n
    UNION ALL SELECT 'independent', b.m, round(b.m / n, 8) FROM b CROSS JOIN n"""))
def joint(spark, sf):
    n = exposure(spark, sf).agg(F.count(F.lit(1)).alias("n")).scalar()
    one = lambda run, name: T.joint_peril_probability(ylt(spark, sf, name), n, YEARS).select(
        F.lit(run).alias("run"), "multi", F.round("probability", 8).alias("probability")
    )
    return one("dependent", "ylt").unionByName(one("independent", "ylt_indep"))


WEIGHT = " + ".join(f"CASE WHEN u > {c!r} THEN 1 ELSE 0 END" for c in T.poisson_one())
# k is a hundredth of all district-years, those without a loss included
BOOT = f"""k AS (SELECT greatest(CAST(floor(count(*) * 1000 * (1 - 99e-2)) AS BIGINT), 1) AS k FROM exposure),
    bd AS (SELECT 'dep' AS run, district_id, year_id, sum(loss) AS loss FROM ylt WHERE loss > 0 GROUP BY 2, 3
      UNION ALL SELECT 'ind', district_id, year_id, sum(loss) FROM ylt_indep WHERE loss > 0 GROUP BY 2, 3),
    bu AS (SELECT bd.*, rep, {uniform("'3'", "'boot'", 'rep', 'district_id', 'year_id')} AS u FROM bd CROSS JOIN (SELECT range + 1 AS rep FROM range(120)) r),
    bw AS (SELECT *, {WEIGHT} AS w FROM bu),
    bh AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY run, rep ORDER BY loss DESC, district_id, year_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM bw),
    bt AS (SELECT rep, sum(CASE WHEN run = 'dep' THEN part END) AS dep, sum(CASE WHEN run = 'ind' THEN part END) AS ind
      FROM (SELECT run, rep, least(w, greatest(k - held, 0)) * loss AS part FROM bh CROSS JOIN k) x GROUP BY rep),
    bci AS (SELECT quantile_cont(100 * (dep / ind - 1), 25e-3) AS ci_low, quantile_cont(100 * (dep / ind - 1), 975e-3) AS ci_high FROM bt)"""


@query("g28_bootstrap_ci", sql(["ylt", "ylt_indep", "exposure"], BOOT + " SELECT round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM bci"))
def bootstrap(spark, sf):
    n = exposure(spark, sf).count() * YEARS
    return r4(T.bootstrap_ci(T.district_years(ylt(spark, sf)), T.district_years(ylt(spark, sf, "ylt_indep")), n), digits=6)


@query("g29_rank_agreement", sql(["ylt", "ylt_indep", "exposure"], """
    a AS (SELECT district_id, sum(loss) AS v FROM ylt GROUP BY 1), b AS (SELECT district_id, sum(loss) AS v FROM ylt_indep GROUP BY 1)
    SELECT round(corr(a.v, b.v), 6) AS corr, round(quantile_cont(abs(b.v - a.v) / greatest(a.v, 1e-9), 5e-1), 6) AS median_move FROM a JOIN b USING (district_id)"""))
def agreement(spark, sf):
    one = lambda name: ylt(spark, sf, name).groupBy("district_id").agg(F.sum("loss").alias("v"))
    return r4(T.rank_agreement(one("ylt"), one("ylt_indep"), "v"), digits=6)


@query("g30_uniformity_ks", """WITH u AS (SELECT o_orderkey, (('0x' || substr(md5(concat_ws('|', '42', 'ks', o_orderkey)), 1, 13))::BIGINT + 5e-1) / pow(16e0, 13) AS u FROM orders),
    r AS (SELECT u, row_number() OVER (ORDER BY u, o_orderkey) AS rn, count(*) OVER () AS n FROM u)
    SELECT round(max(greatest(rn * 1e0 / n - u, u - (rn - 1) * 1e0 / n)), 8) AS ks, count(*) AS n FROM r""")
def ks(spark, sf):
    from ..functions.draws import uniform

    u = load_input(spark, sf, "orders").select("o_orderkey", uniform(42, "ks", F.col("o_orderkey")).alias("u"))
    return T.uniformity_ks(u, "u", "o_orderkey").withColumn("ks", F.round("ks", 8))


@query("g30_kendall_tau", """WITH s AS (SELECT c_custkey AS k, c_acctbal + c_custkey * 1e-9 AS x, (c_acctbal * 7 + c_custkey * 13) % 1009 + c_custkey * 1e-9 AS y FROM customer)
    SELECT round(sum(sign((a.x - b.x) * (a.y - b.y))) / count(*), 8) AS tau, (SELECT count(*) FROM s) AS n FROM s a JOIN s b ON a.k < b.k""")
def kendall(spark, sf):
    s = load_input(spark, sf, "customer").selectExpr(
        "c_custkey AS k", "c_acctbal + c_custkey * 1e-9 AS x", "(c_acctbal * 7 + c_custkey * 13) % 1009 + c_custkey * 1e-9 AS y"
    )
    return T.kendall_tau(s, "x", "y", "k").withColumn("tau", F.round("tau", 8))


VALUE = "v AS (SELECT district_id, round(sum(loss), 4) AS v FROM ylt GROUP BY district_id)"


def values(spark, sf):
    return ylt(spark, sf).groupBy("district_id").agg(F.round(F.sum("loss"), 4).alias("v"))


@query("w1_decile_group", sql("ylt", VALUE + """,
    r AS (SELECT district_id, row_number() OVER (ORDER BY v, district_id) AS rn, count(*) OVER () AS n FROM v)
    SELECT district_id, CAST(greatest(1, ceil((rn - 1) * 10e0 / greatest(n - 1, 1))) AS INT) AS "group" FROM r"""))
def decile(spark, sf):
    return O.decile_group(values(spark, sf), "v", "district_id").select("district_id", "group")


@query("w6_cumulative_share", sql("ylt", VALUE + """
    SELECT district_id, row_number() OVER (ORDER BY v DESC, district_id) AS rank,
      round(sum(v) OVER (ORDER BY v DESC, district_id) / sum(v) OVER (), 6) AS cum_share FROM v"""))
def cumulative(spark, sf):
    return T.cumulative_share(values(spark, sf), "v", "district_id").select(
        "district_id", "rank", F.round("cum_share", 6).alias("cum_share")
    )


@query("w7_first_rank", """SELECT c_custkey, row_number() OVER (ORDER BY floor(c_acctbal / 1000), c_custkey) AS rank FROM customer""")
def first_rank(spark, sf):
    c = load_input(spark, sf, "customer").select("c_custkey", F.floor(F.col("c_acctbal") / 1000).alias("band"))
    return O.running(c, "band", "c_custkey", rank="rank").select("c_custkey", "rank")


@query("t7_top_k", sql("ylt", """
    SELECT year_id, total FROM (SELECT year_id, round(sum(loss), 4) AS total FROM ylt GROUP BY year_id) x ORDER BY total DESC, year_id LIMIT 10"""))
def top_k(spark, sf):
    y = ylt(spark, sf).groupBy("year_id").agg(F.round(F.sum("loss"), 4).alias("total"))
    return Y.worst_years(y, "total", "year_id", 10)


@query("flagship_worst_years", sql(YE, ",\n".join([EL, DY, PORT]) + """,
    dt AS (SELECT district_id, loss, row_number() OVER (PARTITION BY district_id ORDER BY loss DESC, year_id) AS rn FROM dy),
    tl AS (SELECT district_id, sum(loss) / 10 AS tvar99 FROM dt WHERE rn <= 10 GROUP BY district_id),
    p AS (SELECT el.district_id, el_total, coalesce(tvar99, 0) AS tvar99, euler, 6e-2 * greatest(euler - el_total, 0) AS capital,
      round(el_total + 6e-2 * greatest(euler - el_total, 0), 4) AS premium FROM el JOIN eu USING (district_id) LEFT JOIN tl USING (district_id)),
    r AS (SELECT *, row_number() OVER (ORDER BY premium, district_id) AS rn, count(*) OVER () AS n FROM p)
    SELECT district_id, round(el_total, 7) AS el_total, round(tvar99, 5) AS tvar99, round(euler, 5) AS euler, round(capital, 4) AS capital, premium,
      CAST(greatest(1, ceil((rn - 1) * 10e0 / greatest(n - 1, 1))) AS INT) AS "group" FROM r"""))
def flagship(spark, sf):
    from ..plans.rating import price

    e, y = exposure(spark, sf), ylt(spark, sf)
    dy = T.district_years(y)
    rated = (
        T.expected_loss(y, e, YEARS).select("district_id", "el_total")
        .join(T.tail_measures(dy, e, YEARS).select("district_id", "tvar99"), "district_id")
        .join(T.euler_allocation(dy, e, YEARS), "district_id")
    )
    out = price(rated, "el_total", "euler", "el_total").withColumn("premium", F.round("premium", 4))
    out = r4(O.decile_group(out, "premium", "district_id"), "capital")
    return r4(r4(out, "el_total", digits=7), "tvar99", "euler", digits=5)
