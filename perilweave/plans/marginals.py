"""Claim frequency, severity and dependence strength of each district."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.copula import implied_rho, kendall_tau, log_median_for_mean, tau_matched_rho, upper_tail_dependence
from . import assumptions as A


def raw_frequency(erosion_column: str = "er_frac") -> dict[str, Column]:
    """Claim frequencies before calibration, flood split into its two sources."""
    c = F.col
    beyond = lambda outer, inner: F.greatest(c(outer) - c(inner), F.lit(0.0))
    return {
        "p_sub": 0.002 + 0.028 * F.pow(c("sub_score"), F.lit(1.5)),
        "p_wx": 0.010 + 0.090 * F.pow(c("wx_score"), F.lit(1.2)),
        "p_river": 0.0005 + 0.015 * c("f_high") + 0.003 * beyond("f_low", "f_high"),
        "p_surface": 0.010 * c("sw_high") + 0.002 * beyond("sw_low", "sw_high"),
        "p_gw": 0.0003 + 0.008 * c("gw_frac"),
        "p_er": c(erosion_column) / A.EROSION_YEARS,
    }


def marginal_frequency(
    df: DataFrame,
    multiplier: Column | dict[str, float] | None = None,
    assumptions: A.Assumptions = A.Assumptions(),
) -> DataFrame:
    """Add calibrated frequencies; erosion has no published level and stays as it is.

    ``multiplier`` holds one factor per insured peril, as a struct or a dict.
    """
    df = df.withColumns(raw_frequency(assumptions.erosion_column)).withColumn(
        "p_fl", F.expr("p_river + p_surface")
    )
    if multiplier is None:
        scaled = {}
    else:
        scaled = {f"p_{k}": F.col(f"p_{k}") * multiplier[k] for k in A.INSURED}
    if assumptions.flood_frequency_factor != 1.0:
        scaled["p_fl"] = scaled.get("p_fl", F.col("p_fl")) * assumptions.flood_frequency_factor
    return df.withColumns(scaled) if scaled else df


def marginal_severity(df: DataFrame, assumptions: A.Assumptions = A.Assumptions()) -> DataFrame:
    """Add lognormal location and spread of each peril.

    Locations are set before a scenario widens the spread, so a wider spread
    also raises the mean. Flood mixes the locations of its two sources by
    frequency; only the surface-water one feels the depth multiplier.
    """
    base = {k: F.lit(v) for k, v in A.SIGMA.items()}
    mu = {f"mu_{k}": log_median_for_mean(F.lit(A.SEVERITY[k]), base[k]) for k in ("sub", "wx", "gw", "er")}
    river = log_median_for_mean(F.lit(A.SEVERITY["fl_river"]), base["fl"])
    surface = log_median_for_mean(A.SEVERITY["fl_surface"] * F.col("sw_sev"), base["fl"])
    both = F.greatest(F.expr("p_river + p_surface"), F.lit(1e-12))
    mu["mu_fl"] = (F.col("p_river") * river + F.col("p_surface") * surface) / both
    sigma = {f"sigma_{k}": F.lit(v * assumptions.sigma_factor) for k, v in A.SIGMA.items()}
    return df.withColumns({**mu, **sigma})


def pair_strength(df: DataFrame, assumptions: A.Assumptions = A.Assumptions()) -> DataFrame:
    """Add the Gumbel parameter, Kendall's tau and tail dependence of weather with each peril."""
    score = {"sub": "sub_score", "fl": "fl_score", "gw": "gw_score", "er": "er_score"}
    out = {}
    for peril, (base, slope, cap) in A.THETA.items():
        theta = base + slope * F.sqrt(F.col("wx_score") * F.col(score[peril]))
        theta = F.least(F.greatest(theta, F.lit(1.0)), F.lit(cap))
        if assumptions.theta_cap is not None:
            theta = 1 + (theta - 1) * assumptions.theta_factor
            theta = F.least(F.greatest(theta, F.lit(1.0)), F.lit(assumptions.theta_cap))
        out[f"theta_{peril}"] = theta
    df = df.withColumns(out)
    return df.withColumns(
        {
            **{f"tau_{k}": kendall_tau(F.col(f"theta_{k}")) for k in A.THETA},
            **{f"tail_dep_{k}": upper_tail_dependence(F.col(f"theta_{k}")) for k in A.THETA},
        }
    )


def analytic_expected_loss(peril: str) -> Column:
    """Frequency times mean claim, for a peril too rare to draw."""
    s = F.col(f"sigma_{peril}")
    return F.col(f"p_{peril}") * F.exp(F.col(f"mu_{peril}") + s * s / 2)


# The order in which the factor takes the perils.
FACTOR_ORDER = ("wx", "fl", "gw", "sub", "er")


def implied_factor(df: DataFrame, assumptions: A.Assumptions = A.Assumptions()) -> DataFrame:
    """Add the triangular factor of the tau-matched 5 x 5 correlation, as columns c_ij."""
    rho = dict(assumptions.rho)
    df = df.withColumns({f"r_{k}": tau_matched_rho(F.col(f"theta_{k}")) for k in A.THETA})
    partial = lambda a, b: (
        rho[b] if a == "fl" else rho[a] if b == "fl" else rho[a] * rho[b]
    )

    def corr(i: int, j: int) -> Column:
        a, b = FACTOR_ORDER[j], FACTOR_ORDER[i]
        if a == "wx":
            return F.col(f"r_{b}")
        return implied_rho(F.col(f"r_{a}"), F.col(f"r_{b}"), F.lit(partial(a, b)))

    for j in range(5):
        done = lambda i: sum((F.col(f"c_{i}{m}") * F.col(f"c_{j}{m}") for m in range(j)), F.lit(0.0))  # noqa: E731,B023
        df = df.withColumn(f"c_{j}{j}", F.sqrt(1 - done(j)))
        rest = {f"c_{i}{j}": (corr(i, j) - done(i)) / F.col(f"c_{j}{j}") for i in range(j + 1, 5)}
        df = df.withColumns(rest) if rest else df
    return df
