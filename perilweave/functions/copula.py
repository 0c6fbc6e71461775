"""Gumbel and Gaussian dependence, and the claim / no-claim loss distribution.

Everything is Column arithmetic, so a year-loss table stays inside
whole-stage codegen from the draws to the loss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .normal import with_norm_ppf

TINY = 1e-12
EDGE = 1e-9


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


# --- severity ---------------------------------------------------------------

def lognormal_mean(mu: Column, sigma: Column) -> Column:
    return F.exp(mu + sigma * sigma / 2)


def log_median_for_mean(mean: Column, sigma: Column) -> Column:
    """Location parameter that gives a lognormal the wanted mean."""
    return F.log(mean) - sigma * sigma / 2


def with_mixed_quantile(df: DataFrame, targets: dict[str, tuple[str, str, str, str]]) -> DataFrame:
    """Add quantiles of "no claim with 1 - p, else lognormal".

    ``targets`` maps an output to the columns (u, p, mu, sigma). Only claiming
    rows are worked out; for the rest the score stays NULL.
    """
    inside = {
        f"_in_{o}": F.when(
            F.col(u) > 1 - F.col(p), clip((F.col(u) - (1 - F.col(p))) / F.col(p), TINY, 1 - TINY)
        )
        for o, (u, p, _, _) in targets.items()
    }
    df = with_norm_ppf(df.withColumns(inside), {f"_sc_{o}": f"_in_{o}" for o in targets})
    out = {
        o: F.coalesce(F.exp(F.col(mu) + F.col(sigma) * F.col(f"_sc_{o}")), F.lit(0.0))
        for o, (_, _, mu, sigma) in targets.items()
    }
    return df.withColumns(out).drop(*[f"_{t}_{o}" for o in targets for t in ("in", "sc")])


# --- Gumbel pair ------------------------------------------------------------

def kendall_tau(theta: Column) -> Column:
    return 1 - 1 / theta


def upper_tail_dependence(theta: Column) -> Column:
    return 2 - F.pow(F.lit(2.0), 1 / theta)


def gumbel_h(v: Column, u: Column, theta: Column) -> Column:
    """P(V <= v | U = u) under a Gumbel copula.

    With x = -ln u and y = (x^theta + (-ln v)^theta)^(1/theta) this is
    exp(x - y) * (x / y)^(theta - 1).
    """
    x = -F.log(clip(u, TINY, 1 - TINY))
    w = -F.log(clip(v, TINY, 1 - TINY))
    y = F.pow(F.pow(x, theta) + F.pow(w, theta), 1 / theta)
    return F.exp(x - y) * F.pow(x / y, theta - 1)


def with_gumbel_h_inverse(
    df: DataFrame, x: str, targets: dict[str, tuple[str, str]], steps: int = 7
) -> DataFrame:
    """Solve ``gumbel_h(v | u) = t`` for several (t, theta) pairs sharing ``u``.

    ``x`` holds -ln u; ``targets`` maps the output column to (t, theta), all
    column names. Taking logs, with
    d = y - x >= 0, the equation becomes
    d + (theta - 1) * ln(1 + d / x) = -ln t, increasing and concave in d, so
    Newton from any point at or left of the root climbs to it without
    overshooting. Each step is one projection; no row leaves the JVM.
    """
    goals = {}
    for name, (t, theta) in targets.items():
        goals[f"_g_{name}"] = F.expr(f"-ln(least(greatest(`{t}`, {EDGE!r}D), 1 - {EDGE!r}D))")
        goals[f"_b_{name}"] = F.expr(f"`{theta}` - 1")
    df = df.withColumns(goals)
    # Two lower bounds of the root: where the logarithm is replaced by its
    # tangent at 0, and by its value at d = g.
    start = "greatest({g} * `{x}` / (`{x}` + {b}), {g} - {b} * log1p({g} / `{x}`))"
    step = "{d} - ({d} + {b} * log1p({d} / `{x}`) - {g}) * (`{x}` + {d}) / (`{x}` + {d} + {b})"
    for text in [start] + [step] * steps:
        df = df.withColumns(
            {
                f"_d_{n}": F.expr(text.format(x=x, g=f"_g_{n}", b=f"_b_{n}", d=f"_d_{n}"))
                for n in targets
            }
        )
    found = "exp(-`{x}` * pow(expm1(`{theta}` * log1p(_d_{n} / `{x}`)), 1 / `{theta}`))"
    df = df.withColumns(
        {
            n: clip(F.expr(found.format(x=x, theta=theta, n=n)), EDGE, 1 - EDGE)
            for n, (_, theta) in targets.items()
        }
    )
    return df.drop(*[f"_{k}_{n}" for n in targets for k in ("g", "b", "d")])


def stable_frailty(theta: Column, angle: Column, w: Column) -> Column:
    """Positive stable variable with index 1/theta (Chambers-Mallows-Stuck)."""
    a = 1 / theta
    return (
        F.sin(a * angle)
        / F.pow(F.sin(angle), theta)
        * F.pow(F.sin((1 - a) * angle) / w, theta - 1)
    )


def gumbel_margin(e: Column, frailty: Column, theta: Column) -> Column:
    """Uniform margin of a Gumbel pair from a unit exponential and its frailty."""
    return F.exp(-F.pow(e / frailty, 1 / theta))


# --- Gaussian pieces --------------------------------------------------------

def gaussian_conditional_score(rho: float, z_given: Column, z: Column) -> Column:
    """Normal score with correlation ``rho`` to ``z_given``."""
    return rho * z_given + (1 - rho * rho) ** 0.5 * z


def tau_matched_rho(theta: Column) -> Column:
    """Gaussian correlation with the rank correlation of a Gumbel pair."""
    return F.sin(F.lit(3.141592653589793) * (1 - 1 / theta) / 2)


def implied_rho(a: Column, b: Column, partial: float | Column) -> Column:
    """Correlation of two variables from their correlations with a third."""
    return a * b + partial * F.sqrt((1 - a * a) * (1 - b * b))


# --- systemic factor --------------------------------------------------------

def mix_systemic_score(z_systemic: Column, loading: Column, noise: Column) -> Column:
    """Normal score of a district: national factor plus its own noise."""
    return F.sqrt(loading) * z_systemic + F.sqrt(1 - loading) * noise


def conditional_claim_score(z_systemic: Column, threshold: Column, loading: Column) -> Column:
    """Normal score of the claim probability given the national factor."""
    return (F.sqrt(loading) * z_systemic - threshold) / F.sqrt(1 - loading)
