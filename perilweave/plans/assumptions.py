"""Model assumptions as one immutable value; scenarios are changed copies."""

from __future__ import annotations

from dataclasses import dataclass, field


# Published totals of one year, in pounds, and average claims.
POLICIES = 15_500_000
STORM_PAID, FLOOD_PAID, SUBSIDENCE_PAID = 244e6, 312e6, 307e6
TOTAL_HOME_PAID = 3.4e9
SEVERITY = {
    "wx": 2_450.0, "fl": 30_000.0, "sub": 17_820.0, "gw": 20_000.0, "er": 250_000.0,
    "fl_river": 35_000.0, "fl_surface": 18_000.0,
}
GROUNDWATER_SHARE_OF_FLOOD = 0.10
EROSION_YEARS = 80.0
TARGET_FREQUENCY = {
    "wx": STORM_PAID / SEVERITY["wx"] / POLICIES,
    "fl": FLOOD_PAID / SEVERITY["fl"] / POLICIES,
    "sub": SUBSIDENCE_PAID / SEVERITY["sub"] / POLICIES,
    "gw": GROUNDWATER_SHARE_OF_FLOOD * FLOOD_PAID / SEVERITY["fl"] / POLICIES,
}
LOSS_PER_POLICY = (STORM_PAID + FLOOD_PAID + SUBSIDENCE_PAID) / POLICIES

# Spread of claims, dependence given weather, how national a year is.
SIGMA = {"sub": 0.90, "wx": 1.10, "fl": 0.90, "gw": 0.80, "er": 0.35}
RHO_GIVEN_WEATHER = {"sub": 0.15, "gw": 0.25, "er": 0.35}
BASE_LOADING = {"wx": 0.50, "fl": 0.40, "sub": 0.60, "gw": 0.70}
LOADING_CAP = 0.98
TAIL_FREQUENCY_RATIO = 2.0
COST_OF_CAPITAL = 0.06

# Gumbel strength of weather with each peril: base, slope, cap.
THETA = {
    "sub": (1.25, 1.25, 2.5),
    "fl": (1.40, 1.60, 3.0),
    "gw": (1.30, 1.10, 2.4),
    "er": (1.35, 1.30, 2.6),
}

INSURED = ("sub", "wx", "fl", "gw")
PERILS = INSURED + ("er",)


@dataclass(frozen=True)
class Assumptions:
    """Everything a scenario may change."""

    name: str = "baseline"
    theta_factor: float = 1.0
    theta_cap: float | None = None
    rho: dict[str, float] = field(default_factory=lambda: dict(RHO_GIVEN_WEATHER))
    sigma_factor: float = 1.0
    flood_frequency_factor: float = 1.0
    erosion_column: str = "er_frac"
