"""Distribution functions, copulas and calibration."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from ..functions import copula as C
from ..functions.draws import uniform
from ..functions.normal import with_norm_cdf, with_norm_ppf
from ..plans import assumptions as A
from ..plans.calibrate import calibrate_loading, frequency_multipliers, loadings
from ..plans.marginals import FACTOR_ORDER, implied_factor, marginal_frequency, pair_strength
from . import sqltext as Q
from .base import load_input, query, sql
from .rules import FREQ, MULT


def scored(spark, sf):
    return load_input(spark, sf, "scored")


def order_draws(spark, sf):
    """One uniform per order, three independent ones for copula checks."""
    o = load_input(spark, sf, "orders")
    key = F.col("o_orderkey")
    return o.select("o_orderkey", *[uniform(7, n, key).alias(n) for n in ("u", "v", "t")])


DRAWN = "o AS (SELECT o_orderkey, " + ", ".join(
    f"{Q.uniform(repr('7'), repr(n), 'o_orderkey')} AS {n}" for n in ("u", "v", "t")
) + " FROM orders)"


@query("f1_norm_cdf", """SELECT o_orderkey, round(""" + Q.cdf("x") + """, 10) AS p FROM (SELECT o_orderkey, (o_totalprice - 25e4) / 6e4 AS x FROM orders) k""")
def norm_cdf(spark, sf):
    o = load_input(spark, sf, "orders").selectExpr("o_orderkey", "(o_totalprice - 25e4) / 6e4 AS x")
    return with_norm_cdf(o, {"p": "x"}).select("o_orderkey", F.round("p", 10).alias("p"))


@query("f2_norm_ppf", f"WITH {DRAWN} SELECT o_orderkey, round({Q.ppf('u')}, 8) AS z FROM o")
def norm_ppf(spark, sf):
    return with_norm_ppf(order_draws(spark, sf), {"z": "u"}).select("o_orderkey", F.round("z", 8).alias("z"))


@query("f3_lognormal_median", """SELECT p_partkey, round(ln(p_retailprice) - 81e-2 / 2, 8) AS mu, round(exp(ln(p_retailprice) - 81e-2 / 2 + 81e-2 / 2), 4) AS mean FROM part""")
def lognormal(spark, sf):
    p = load_input(spark, sf, "part")
    mu = C.log_median_for_mean(F.col("p_retailprice"), F.lit(0.9))
    return p.select("p_partkey", F.round(mu, 8).alias("mu"), F.round(C.lognormal_mean(mu, F.lit(0.9)), 4).alias("mean"))


@query("f4_mixed_quantile", f"""WITH {DRAWN}, c AS (SELECT o_orderkey, CASE WHEN u > 95e-2 THEN least(greatest((u - 95e-2) / 5e-2, 1e-12), 1 - 1e-12) END AS ins FROM o)
    SELECT o_orderkey, round(coalesce(exp(ln(1e4) + 9e-1 * ({Q.ppf('ins')})), 0), 2) AS loss FROM c""")
def mixed(spark, sf):
    d = order_draws(spark, sf).withColumns({"p": F.lit(0.05), "mu": F.log(F.lit(1e4)), "sigma": F.lit(0.9)})
    return C.with_mixed_quantile(d, {"loss": ("u", "p", "mu", "sigma")}).select("o_orderkey", F.round("loss", 2).alias("loss"))


@query("f5_gumbel_h", f"""WITH {DRAWN}, a AS (SELECT o_orderkey, u, pow(-ln(u), 22e-1) AS a, pow(-ln(v), 22e-1) AS b FROM o)
    SELECT o_orderkey, round(exp(-pow(a + b, 1 / 22e-1)) * pow(-ln(u), 12e-1) / u * pow(a + b, 1 / 22e-1 - 1), 8) AS h FROM a""")
def gumbel_h(spark, sf):
    h = C.gumbel_h(F.col("v"), F.col("u"), F.lit(2.2))
    return order_draws(spark, sf).select("o_orderkey", F.round(h, 8).alias("h"))


def _bisect(steps: int) -> str:
    out = "b0 AS (SELECT o_orderkey, u, t, 1e-9 AS lo, 1 - 1e-9 AS hi FROM o)"
    for i in range(steps):
        h = """exp(-pow(pow(-ln(u), 22e-1) + pow(-ln((lo + hi) / 2), 22e-1), 1 / 22e-1)) * pow(-ln(u), 12e-1) / u
          * pow(pow(-ln(u), 22e-1) + pow(-ln((lo + hi) / 2), 22e-1), 1 / 22e-1 - 1)"""
        out += f""", h{i} AS (SELECT *, {h} < t AS below FROM b{i}),
        b{i + 1} AS (SELECT o_orderkey, u, t, CASE WHEN below THEN (lo + hi) / 2 ELSE lo END AS lo, CASE WHEN below THEN hi ELSE (lo + hi) / 2 END AS hi FROM h{i})"""
    return out


@query("f6_gumbel_h_inverse", f"WITH {DRAWN}, {_bisect(40)} SELECT o_orderkey, round((lo + hi) / 2, 8) AS v FROM b40")
def gumbel_h_inverse(spark, sf):
    d = order_draws(spark, sf).select("o_orderkey", "t", (-F.log("u")).alias("x"), F.lit(2.2).alias("theta"))
    return C.with_gumbel_h_inverse(d, "x", {"v": ("t", "theta")}).select("o_orderkey", F.round("v", 8).alias("v"))


@query("f7_gumbel_pair", f"""WITH {DRAWN},
    f AS (SELECT *, sin(3.141592653589793e0 * u / 22e-1) / pow(sin(3.141592653589793e0 * u), 22e-1) * pow(sin((1 - 1 / 22e-1) * 3.141592653589793e0 * u) / -ln(v), 12e-1) AS s FROM o)
    SELECT o_orderkey, round(exp(-pow(-ln(t) / s, 1 / 22e-1)), 8) AS u1, round(exp(-pow(-ln(1 - t) / s, 1 / 22e-1)), 8) AS u2 FROM f""")
def gumbel_pair(spark, sf):
    th = F.lit(2.2)
    s = C.stable_frailty(th, F.lit(3.141592653589793) * F.col("u"), -F.log("v"))
    d = order_draws(spark, sf).withColumn("s", s)
    return d.select(
        "o_orderkey", F.round(C.gumbel_margin(-F.log("t"), F.col("s"), th), 8).alias("u1"),
        F.round(C.gumbel_margin(-F.log(1 - F.col("t")), F.col("s"), th), 8).alias("u2"),
    )


@query("f8_gaussian_conditional", f"""WITH {DRAWN}, z AS (SELECT o_orderkey, {Q.ppf('u')} AS a, {Q.ppf('v')} AS b FROM o),
    s AS (SELECT o_orderkey, 35e-2 * a + sqrt(1 - 35e-2 * 35e-2) * b AS s FROM z) SELECT o_orderkey, round({Q.cdf('s')}, 8) AS t FROM s""")
def gaussian_conditional(spark, sf):
    d = with_norm_ppf(order_draws(spark, sf).drop("t"), {"a": "u", "b": "v"})
    d = d.withColumn("s", C.gaussian_conditional_score(0.35, F.col("a"), F.col("b")))
    return with_norm_cdf(d, {"t": "s"}).select("o_orderkey", F.round("t", 8).alias("t"))


def _factor_sql() -> str:
    """CTEs ending in ``f5``: the factor column by column."""
    rho = A.Assumptions().rho
    partial = lambda a, b: rho[b] if a == "fl" else rho[a] if b == "fl" else rho[a] * rho[b]
    out = "f0 AS (SELECT district_id, " + ", ".join(
        f"sin(pi() * (1 - 1 / th_{k}) / 2) AS r_{k}" for k in FACTOR_ORDER[1:]
    ) + " FROM pm)"
    for j, a in enumerate(FACTOR_ORDER):
        done = lambda i: " + ".join(["0e0", *(f"c_{i}{m} * c_{j}{m}" for m in range(j))])  # noqa: E731,B023
        out += f",\n    g{j} AS (SELECT *, sqrt(1 - ({done(j)})) AS c_{j}{j} FROM f{j})"
        rest = ""
        for i in range(j + 1, 5):
            b = FACTOR_ORDER[i]
            corr = f"r_{b}" if a == "wx" else f"(r_{a} * r_{b} + {partial(a, b)!r} * sqrt((1 - r_{a} * r_{a}) * (1 - r_{b} * r_{b})))"
            rest += f", ({corr} - ({done(i)})) / c_{j}{j} AS c_{i}{j}"
        out += f",\n    f{j + 1} AS (SELECT *{rest} FROM g{j})"
    return out


FACTORS = [f"c_{i}{j}" for i in range(5) for j in range(i + 1)]


@query("f9_implied_correlation", sql("scored", MULT + ", " + Q.PARAMS + ", " + _factor_sql() + """
    SELECT district_id, """ + ", ".join(f"round({c}, 6) AS {c}" for c in FACTORS) + " FROM f5"))
def implied(spark, sf):
    p = implied_factor(pair_strength(scored(spark, sf)))
    return p.select("district_id", *[F.round(c, 6).alias(c) for c in FACTORS])


@query("f10_mix_systemic", f"""WITH {DRAWN}, z AS (SELECT o_orderkey, {Q.ppf('u')} AS a, {Q.ppf('v')} AS b FROM o),
    s AS (SELECT o_orderkey, sqrt(4e-1) * a + sqrt(6e-1) * b AS s FROM z) SELECT o_orderkey, round({Q.cdf('s')}, 8) AS u FROM s""")
def mix(spark, sf):
    d = with_norm_ppf(order_draws(spark, sf).select("o_orderkey", "u", "v"), {"a": "u", "b": "v"})
    d = d.withColumn("s", C.mix_systemic_score(F.col("a"), F.lit(0.4), F.col("b"))).drop("u")
    return with_norm_cdf(d, {"u": "s"}).select("o_orderkey", F.round("u", 8).alias("u"))


@query("f11_conditional_expected", f"""WITH {DRAWN}, c AS (SELECT o_orderkey, u, 1 - 1e-2 AS th FROM o), z AS (SELECT o_orderkey, {Q.ppf('u')} AS a, {Q.ppf('th')} AS b FROM c),
    s AS (SELECT o_orderkey, (sqrt(4e-1) * a - b) / sqrt(6e-1) AS s FROM z) SELECT o_orderkey, round(3e4 * ({Q.cdf('s')}), 4) AS expected FROM s""")
def conditional(spark, sf):
    d = order_draws(spark, sf).select("o_orderkey", "u", F.lit(0.99).alias("th"))
    d = with_norm_ppf(d, {"a": "u", "b": "th"})
    d = d.withColumn("s", C.conditional_claim_score(F.col("a"), F.col("b"), F.lit(0.4)))
    return with_norm_cdf(d, {"q": "s"}).select("o_orderkey", F.round(3e4 * F.col("q"), 4).alias("expected"))


@query("s7_calibrate_frequency", sql("scored", MULT + """
    SELECT round(k_sub, 8) AS sub, round(k_wx, 8) AS wx, round(k_fl, 8) AS fl, round(k_gw, 8) AS gw FROM m"""))
def calibrate(spark, sf):
    return frequency_multipliers(scored(spark, sf)).select(*[F.round(k, 8).alias(k) for k in ("sub", "wx", "fl", "gw")])


def loading_factor(spark, sf):
    s = scored(spark, sf)
    return calibrate_loading(marginal_frequency(s, frequency_multipliers(s).first().asDict()))


def _bracket_sql(rounds: int = 5, points: int = 128) -> str:
    """CTEs ending in ``b{rounds}``: the bracket of the loading factor, narrowed as the fit does."""
    z = f"{NormalDist().inv_cdf(0.99)!r}"
    load = {k: f"least({A.BASE_LOADING[k]!r} * f, {A.LOADING_CAP!r})" for k in A.INSURED}
    odds = ", ".join(f"least(greatest(1 - q_{k}, {C.TINY!r}), 1 - {C.TINY!r}) AS o_{k}, q_{k}" for k in A.INSURED)
    out = f"o AS (SELECT households, {odds} FROM pm), t AS (SELECT households, " + ", ".join(
        f"{Q.ppf(f'o_{k}')} AS t_{k}, q_{k}" for k in A.INSURED
    ) + " FROM o), b0 AS (SELECT 1e-2 AS lo, 1e0 AS hi)"
    for r in range(1, rounds + 1):
        scores = ", ".join(f"(sqrt({load[k]}) * {z} - t_{k}) / sqrt(1 - {load[k]}) AS s_{k}" for k in A.INSURED)
        out += f""",
    g{r} AS (SELECT lo, hi, i, lo + (hi - lo) * i / {points - 1} AS f FROM b{r - 1}, range({points}) x(i)),
    s{r} AS (SELECT lo, hi, i, f, households, {" + ".join(f"q_{k}" for k in A.INSURED)} AS q, {scores} FROM g{r}, t),
    e{r} AS (SELECT lo, hi, i, f, sum(households * ({" + ".join(f"({Q.cdf(f's_{k}')})" for k in A.INSURED)})) > {A.TAIL_FREQUENCY_RATIO!r} * sum(households * q) AS over
      FROM s{r} GROUP BY lo, hi, i, f),
    b{r} AS (SELECT CASE WHEN n IS NULL THEN top ELSE below END AS lo, CASE WHEN n IS NULL THEN top WHEN n = 0 THEN below ELSE hit END AS hi FROM (
      SELECT n, max(hi) AS top, max(CASE WHEN i = n THEN f END) AS hit, max(CASE WHEN i = greatest(n - 1, 0) THEN f END) AS below
      FROM e{r}, (SELECT min(i) FILTER (over) AS n FROM e{r}) GROUP BY n))"""
    return out


@query("s8_calibrate_loading", sql("scored", MULT + ", " + Q.PARAMS + ", " + _bracket_sql() + """,
    f AS (SELECT (lo + hi) / 2 AS f FROM b5)
    SELECT round(f, 6) AS factor, """ + ", ".join(
        f"round(least({A.BASE_LOADING[k]!r} * f, {A.LOADING_CAP!r}), 6) AS load_{k}" for k in A.BASE_LOADING
    ) + ", (SELECT count(*) FROM scored) AS districts FROM f"))
def loading(spark, sf):
    factor = loading_factor(spark, sf)
    return scored(spark, sf).agg(
        F.lit(round(factor, 6)).alias("factor"), *[F.lit(round(v, 6)).alias(f"load_{k}") for k, v in loadings(factor).items()],
        F.count(F.lit(1)).alias("districts"),
    )


@query("g16_analytic_expected_loss", sql("scored", FREQ + """
    SELECT district_id, round(p_er * exp(ln(25e4) - 35e-2 * 35e-2 / 2 + 35e-2 * 35e-2 / 2), 4) AS el_er FROM p"""))
def analytic(spark, sf):
    from ..plans.marginals import analytic_expected_loss, marginal_severity

    s = marginal_severity(marginal_frequency(scored(spark, sf)))
    return s.select("district_id", F.round(analytic_expected_loss("er"), 4).alias("el_er"))
