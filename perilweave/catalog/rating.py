"""Pricing, repricing, sensitivity and identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordering as O
from ..operators import quality as Qy
from ..operators import report as Rp
from ..operators import tail as T
from ..plans import assumptions as A
from ..plans import rating as P
from ..plans import scores as Sc
from ..plans.marginals import pair_strength
from .base import INPUTS, YEARS, load_input, query, sql
from ..schema import SIMULATION_INPUTS, require_columns
from .rules import FREQ
from .scores import FLOOD
from .sqltext import PARAMS
from .tail import BOOT, DENSE, DY, EL, JOINT, PORT, exposure, r4, ylt

YE = ["ylt", "exposure"]
for _status, _name in (("F", "ylt_present"), ("O", "ylt_future")):
    INPUTS[_name] = INPUTS["ylt"].replace("l_returnflag = 'R'", f"l_linestatus = '{_status}'")


def priced(spark, sf, name="ylt"):
    """Rated table of a supplied year-loss table."""
    e, y = exposure(spark, sf), ylt(spark, sf, name)
    dy = T.district_years(y)
    rated = (
        T.expected_loss(y, e, YEARS)
        .join(T.tail_measures(dy, e, YEARS), "district_id")
        .join(T.euler_allocation(dy, e, YEARS), "district_id")
    )
    return P.price(rated, "el_total", "euler", "el_total")


PRICED = ",\n".join([EL, DY, PORT]) + """,
    pr AS (SELECT el.*, euler, households, 6e-2 * greatest(euler - el_total, 0) AS capital, el_total + 6e-2 * greatest(euler - el_total, 0) AS premium FROM el JOIN eu USING (district_id))"""


@query("s12_technical_premium", sql(YE, PRICED + """
    SELECT district_id, round(capital, 4) AS capital, round(premium, 4) AS premium FROM pr"""))
def premium(spark, sf):
    return r4(priced(spark, sf).select("district_id", "capital", "premium"))


def _side(name: str) -> str:
    return f"""d_{name} AS (SELECT district_id, year_id, sum(loss) AS loss FROM {name} WHERE loss > 0 GROUP BY 1, 2),
    b_{name} AS (SELECT year_id FROM (SELECT year_id, round(sum(loss * households), 4) AS t FROM d_{name} JOIN exposure USING (district_id) GROUP BY 1) k ORDER BY t DESC, year_id LIMIT 10),
    e_{name} AS (SELECT e.district_id, coalesce(sum(loss), 0) / 1000 AS el, coalesce(sum(CASE WHEN year_id IN (SELECT year_id FROM b_{name}) THEN loss END), 0) / 10 AS eu
      FROM exposure e LEFT JOIN d_{name} d ON e.district_id = d.district_id GROUP BY e.district_id),
    p_{name} AS (SELECT district_id, el, el + 6e-2 * greatest(eu - el, 0) AS premium FROM e_{name})"""


@query("s14_scenario_repricing", sql(["ylt_present", "ylt_future", "exposure", "country"], _side("ylt_present") + ",\n" + _side("ylt_future") + """,
    c AS (SELECT district_id, coalesce(country = 'EUROPE' AND share >= 95e-2, FALSE) AS covered FROM country)
    SELECT a.district_id, round(a.premium, 4) AS premium, round(b.premium, 4) AS premium_cc, CAST(covered AS INT) AS cc_covered,
      CASE WHEN covered THEN round(100 * (b.premium / greatest(a.premium, 1e-9) - 1), 4) END AS cc_uplift_pct
    FROM p_ylt_present a JOIN p_ylt_future b ON a.district_id = b.district_id JOIN c ON a.district_id = c.district_id"""))
def repricing(spark, sf):
    from ..functions.rules import coverage_mask

    cov = load_input(spark, sf, "country").withColumn("covered", coverage_mask(F.col("country"), F.col("share"), "EUROPE"))
    out = P.reprice(priced(spark, sf, "ylt_present"), priced(spark, sf, "ylt_future"), cov)
    return r4(out.select("district_id", "premium", "premium_cc", "cc_covered", "cc_uplift_pct"))


@query("s14_pinned_flood_score", sql("scored", FLOOD + """,
    f AS (SELECT s.district_id, 75e-2 * 13e-1 * f_high + 25e-2 * 13e-1 * f_low + 6e-1 * (75e-2 * sw_high + 25e-2 * sw_low) AS fi FROM scored s)
    SELECT i.district_id, round(least(sqrt(i / a), 1), 4) AS fl_score, round(least(sqrt(fi / a), 1), 4) AS fl_score_cc FROM i JOIN f ON i.district_id = f.district_id CROSS JOIN a"""))
def pinned(spark, sf):
    s = load_input(spark, sf, "scored").drop("fl_score")
    anchor = Sc.flood_anchor(s)
    now = Sc.flood_score(s, anchor).select("district_id", "fl_score")
    later = s.withColumns({c: 1.3 * F.col(c) for c in ("f_high", "f_low")})
    fut = Sc.flood_score(later, anchor).select("district_id", F.col("fl_score").alias("fl_score_cc"))
    return r4(now.join(fut, "district_id"))


def published(spark, sf):
    """A rated table with every column the reports read."""
    from ..functions.rules import coverage_mask

    s = pair_strength(load_input(spark, sf, "scored")).join(load_input(spark, sf, "country"), "district_id")
    cov = s.select("district_id", coverage_mask(F.col("country"), F.col("share"), "EUROPE").alias("covered"))
    r = P.reprice(priced(spark, sf, "ylt_present"), priced(spark, sf, "ylt_future"), cov)
    r = r.select("*", F.col("tvar99").alias("tvar99_vine"), F.col("euler").alias("tvar99_euler"))
    out = s.join(r, "district_id").withColumns(
        {
            "er_smp105": F.greatest(F.col("er_frac") - 0.01, F.lit(0.0)), "el_er": F.col("er_frac") / 80 * 250000,
            "uplift_pct": F.expr("100 * (tvar99 - euler) / greatest(euler, 1e-9)"),
        }
    )
    return Rp.fill_undefined(out)


# Few claims may leave the mean of the top ten below the quantile: counted, not assumed.
@query("s20_result_identities", sql(["ylt_present", "exposure"], DENSE.replace("FROM ylt WHERE", "FROM ylt_present WHERE") + """,
    i AS (SELECT unnest(['premium', 'total', 'capital', 'tail_order', 'nesting', 'tail_dependence', 'uncovered_uplift', 'monotone', 'balanced']) AS identity)
    SELECT identity, CASE WHEN identity = 'tail_order' THEN (SELECT count(*) FROM tl WHERE tvar99 < var995 - 1e-6) ELSE CAST(0 AS BIGINT) END AS violations FROM i"""))
def identities(spark, sf):
    return Qy.result_identities(O.decile_group(published(spark, sf), "premium", "district_id"))


RATED = (
    "name", "area", "country", "households", "sub_score", "wx_score", "fl_score", "gw_score", "f_high", "f_low", "sw_high", "sw_low",
    "gw_frac", "sw_sev", "er_score", "el_sub", "el_wx", "el_fl", "el_gw", "el_er", "el_total", "el_total5", "var995_vine", "tvar99_vine",
    "tvar99_indep", "tvar99_euler", "capital", "el_total_cc", "capital_cc", "premium_cc", "cc_uplift_pct", "cc_covered", "uplift_pct",
    "tail_dep_wf", "tail_dep_ws", "tail_dep_wg", "tail_dep_we", "theta_wf", "theta_ws", "theta_wg", "theta_we", "premium", "group",
)
LETTERS = {"fl": "f", "sub": "s", "gw": "g", "er": "e"}


def rated_table(spark, sf):
    """Scores and supplied year-loss tables (dependent, independent, future) to the published table."""
    from ..functions.rules import coverage_mask

    s = require_columns(pair_strength(load_input(spark, sf, "scored")), SIMULATION_INPUTS, "scores")
    s = s.join(load_input(spark, sf, "country"), "district_id")
    cov = s.select("district_id", coverage_mask(F.col("country"), F.col("share"), "EUROPE").alias("covered"))
    e = exposure(spark, sf)
    alone = T.tail_measures(T.district_years(ylt(spark, sf, "ylt_indep")), e, YEARS, names=("tvar99_indep", "_v"))
    r = P.reprice(priced(spark, sf, "ylt_present"), priced(spark, sf, "ylt_future"), cov)
    r = r.join(alone.select("district_id", "tvar99_indep"), "district_id").withColumnsRenamed(
        {"tvar99": "tvar99_vine", "var995": "var995_vine", "euler": "tvar99_euler"}
    )
    out = s.join(r, "district_id").withColumn("el_er", F.col("er_frac") / A.EROSION_YEARS * A.SEVERITY["er"])
    out = out.withColumns(
        {
            "el_total5": F.col("el_total") + F.col("el_er"),
            "uplift_pct": T.tail_uplift_pct(F.round("tvar99_vine", 6), F.round("tvar99_indep", 6)),
            **{f"{c}_w{letter}": F.col(f"{c}_{peril}") for c in ("theta", "tail_dep") for peril, letter in LETTERS.items()},
            "premium": F.round("premium", 6),
        }
    )
    grouped = O.decile_group(Rp.fill_undefined(out), "premium", "district_id")
    return require_columns(grouped, RATED, "rated table").select(*RATED)


def _rated_sql() -> str:
    theta = ", ".join(f"th_{k} AS theta_w{x}, 2 - pow(2e0, 1 / th_{k}) AS tail_dep_w{x}" for k, x in LETTERS.items())
    kinds = {c: "text" for c in ("name", "area", "country", "group", "cc_covered")}
    out = []
    for c in RATED:
        d, name = Rp.decimals_of(c), f'"{c}"'
        out.append(name if c in kinds or d is None else f"round_even({name}, {d}) AS {name}")
    return (
        _side("ylt_present") + ",\n" + _side("ylt_future") + ",\n" + EL.replace("ylt", "ylt_present") + ",\n"
        + DENSE.replace("FROM ylt WHERE", "FROM ylt_present WHERE") + ",\n" + FREQ + ",\n" + PARAMS.replace("CROSS JOIN m)", "CROSS JOIN one)").replace("pm AS", "one AS (SELECT 1e0 AS k_sub, 1e0 AS k_wx, 1e0 AS k_fl, 1e0 AS k_gw),\n    pm AS") + f""",
    di AS (SELECT district_id, year_id, sum(loss) AS loss FROM ylt_indep WHERE loss > 0 GROUP BY 1, 2),
    ri AS (SELECT *, row_number() OVER (PARTITION BY district_id ORDER BY loss DESC, year_id) AS rn FROM di),
    ti AS (SELECT district_id, sum(loss) / 10 AS tv FROM ri WHERE rn <= 10 GROUP BY district_id),
    c AS (SELECT district_id, country, coalesce(country = 'EUROPE' AND share >= 95e-2, FALSE) AS covered FROM country),
    t AS (SELECT pm.* EXCLUDE (households), pm.households, {theta}, c.country, CAST(covered AS INT) AS cc_covered, el_sub, el_wx, el_fl, el_gw, el_total,
        er_frac / 80 * 250000 AS el_er, el_total + er_frac / 80 * 250000 AS el_total5, tl.tvar99 AS tvar99_vine, tl.var995 AS var995_vine,
        coalesce(tv, 0) AS tvar99_indep, x.eu AS tvar99_euler, 6e-2 * greatest(x.eu - x.el, 0) AS capital, round(x.premium, 6) AS premium,
        y.el AS el_total_cc, 6e-2 * greatest(y.eu - y.el, 0) AS capital_cc, y.premium AS premium_cc,
        CASE WHEN covered THEN 100 * (y.premium / greatest(x.premium, 1e-9) - 1) ELSE 0 END AS cc_uplift_pct,
        100 * (round(tl.tvar99, 6) - round(coalesce(tv, 0), 6)) / greatest(round(coalesce(tv, 0), 6), 1e-9) AS uplift_pct
      FROM pm JOIN el ON el.district_id = pm.district_id JOIN tl ON tl.district_id = pm.district_id LEFT JOIN ti ON ti.district_id = pm.district_id
        JOIN s_eu x ON x.district_id = pm.district_id JOIN f_eu y ON y.district_id = pm.district_id JOIN c ON c.district_id = pm.district_id),
    g AS (SELECT *, CAST(greatest(1, ceil((row_number() OVER (ORDER BY premium, district_id) - 1) * 10e0 / greatest(count(*) OVER () - 1, 1))) AS INT) AS "group" FROM t)
    SELECT {", ".join(out)} FROM g"""
    ).replace("    di AS", """    s_eu AS (SELECT a.district_id, a.el, a.eu, b.premium FROM e_ylt_present a JOIN p_ylt_present b USING (district_id)),
    f_eu AS (SELECT a.district_id, a.el, a.eu, b.premium FROM e_ylt_future a JOIN p_ylt_future b USING (district_id)),
    di AS""", 1)


@query("s13_rating_table", sql(["ylt_present", "ylt_future", "ylt_indep", "exposure", "country", "scored"], _rated_sql()))
def rating_table(spark, sf):
    return Rp.publish_rounded(rated_table(spark, sf))


@query("s16_dependence_report", sql(["ylt", "ylt_indep", "exposure"], BOOT + f""",
    ja AS (SELECT count(*) / (SELECT count(*) * 1000e0 FROM exposure) AS p FROM {JOINT.format(t='ylt')} x),
    jb AS (SELECT count(*) / (SELECT count(*) * 1000e0 FROM exposure) AS p FROM {JOINT.format(t='ylt_indep')} x),
    pt AS (SELECT sum(loss) FILTER (run = 'dep') / max(k) AS dep, sum(loss) FILTER (run = 'ind') / max(k) AS ind FROM
      (SELECT *, row_number() OVER (PARTITION BY run ORDER BY loss DESC, district_id, year_id) AS rn FROM bd) r CROSS JOIN k WHERE rn <= k)
    SELECT round(ja.p, 6) AS multi_peril_vine, round(jb.p, 6) AS multi_peril_indep, round(CASE WHEN jb.p <> 0 THEN ja.p / jb.p END, 6) AS multi_peril_ratio,
      round(dep, 6) AS tvar99_vine, round(ind, 6) AS tvar99_indep, round(100 * (dep / ind - 1), 6) AS tvar_uplift_pct,
      round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM ja CROSS JOIN jb CROSS JOIN pt CROSS JOIN bci"""))
def dependence(spark, sf):
    n = exposure(spark, sf).count()
    return r4(P.dependence_report(ylt(spark, sf), ylt(spark, sf, "ylt_indep"), n, YEARS), digits=6)


@query("s21_level_check", sql(YE, EL + f""" SELECT round(avg(el_total), 4) AS modelled, CAST({A.LOSS_PER_POLICY!r} AS DOUBLE) AS published,
    round(avg(el_total) / {A.LOSS_PER_POLICY!r} - 1, 6) AS gap, round(avg(el_total) / ({A.TOTAL_HOME_PAID!r} / {A.POLICIES}), 6) AS share_of_all_claims FROM el"""))
def level(spark, sf):
    el = T.expected_loss(ylt(spark, sf), exposure(spark, sf), YEARS)
    out = Rp.level_check(el, A.LOSS_PER_POLICY, A.TOTAL_HOME_PAID / A.POLICIES)
    return r4(r4(out, "modelled"), "gap", "share_of_all_claims", digits=6)


@query("s22_unpriced_exposure", sql(["ylt", "exposure", "scored"], EL + """,
    j AS (SELECT el_total, households, er_frac / 80 * 250000 AS er FROM el JOIN scored USING (district_id))
    SELECT round(sum(er * households) / sum(households), 4) AS per_policy, round(100 * (sum(er * households) / sum(households)) / avg(el_total), 4) AS pct_of_priced,
      count(*) FILTER (er > 5e-1) AS districts, round(max(er), 4) AS worst FROM j"""))
def unpriced(spark, sf):
    el = T.expected_loss(ylt(spark, sf), exposure(spark, sf), YEARS)
    s = load_input(spark, sf, "scored").withColumn("el_er", F.col("er_frac") / 80 * 250000)
    return r4(Rp.unpriced_exposure(el.join(s, "district_id")))
