"""Longitude / latitude to National Grid metres, by the published formulas.

A seven-parameter shift from WGS84 to the Airy ellipsoid followed by the
transverse Mercator series: good to a few metres, no grid-shift file needed.
"""

from __future__ import annotations

from math import radians

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Ellipsoid axes, datum shift (metres, parts per million, seconds
# of arc) and the projection's origin, scale and false origin.
WGS84 = (6378137.0, 6356752.3142)
AIRY = (6377563.396, 6356256.909)
SHIFT = (-446.448, 125.157, -542.060)
SHIFT_PPM = 20.4894
ROTATION_SECONDS = (-0.1502, -0.2470, -0.8421)
ORIGIN_LAT, ORIGIN_LON = 49.0, -2.0
SCALE = 0.9996012717
FALSE_EAST, FALSE_NORTH = 400000.0, -100000.0
LATITUDE_STEPS = 4


def _e2(axes: tuple[float, float]) -> float:
    return 1 - (axes[1] / axes[0]) ** 2


def to_grid_metres(df: DataFrame, lon: str, lat: str) -> DataFrame:
    """Add ``easting`` and ``northing``."""
    keep = df.columns
    a, e2 = WGS84[0], _e2(WGS84)
    df = df.withColumns({"_f": F.radians(lat), "_l": F.radians(lon)})
    df = df.withColumn("_nu", a / F.sqrt(1 - e2 * F.sin("_f") * F.sin("_f")))
    df = df.withColumns(
        {
            "_x": F.col("_nu") * F.cos("_f") * F.cos("_l"),
            "_y": F.col("_nu") * F.cos("_f") * F.sin("_l"),
            "_z": (1 - e2) * F.col("_nu") * F.sin("_f"),
        }
    )
    rx, ry, rz = (radians(s / 3600) for s in ROTATION_SECONDS)
    s = 1 + SHIFT_PPM * 1e-6
    x, y, z = F.col("_x"), F.col("_y"), F.col("_z")
    df = df.withColumns(
        {
            "_x": SHIFT[0] + s * x - rz * y + ry * z,
            "_y": SHIFT[1] + rz * x + s * y - rx * z,
            "_z": SHIFT[2] - ry * x + rx * y + s * z,
        }
    )
    a, e2 = AIRY[0], _e2(AIRY)
    f = F.col("_f")
    df = df.withColumn("_p", F.hypot(x, y)).withColumns(
        {"_l": F.atan2(y, x), "_f": F.atan2(z, F.col("_p") * (1 - e2))}
    )
    for _ in range(LATITUDE_STEPS):
        bulge = e2 * a / F.sqrt(1 - e2 * F.sin(f) * F.sin(f)) * F.sin(f)
        df = df.withColumn("_f", F.atan2(z + bulge, F.col("_p")))
    n = (AIRY[0] - AIRY[1]) / (AIRY[0] + AIRY[1])
    f0 = radians(ORIGIN_LAT)
    away, both = f - f0, f + f0
    arc = SCALE * AIRY[1] * (
        (1 + n + 5 / 4 * (n**2 + n**3)) * away
        - (3 * n + 3 * n**2 + 21 / 8 * n**3) * F.sin(away) * F.cos(both)
        + 15 / 8 * (n**2 + n**3) * F.sin(2 * away) * F.cos(2 * both)
        - 35 / 24 * n**3 * F.sin(3 * away) * F.cos(3 * both)
    )
    curve = 1 - e2 * F.sin(f) * F.sin(f)
    df = df.withColumns(
        {
            "_d": F.col("_l") - radians(ORIGIN_LON),
            "_arc": arc,
            "_nu": SCALE * a / F.sqrt(curve),
            "_rho": SCALE * a * (1 - e2) / F.pow(curve, F.lit(1.5)),
            "_t2": F.tan(f) * F.tan(f),
            "_c": F.cos(f),
            "_s": F.sin(f),
        }
    ).withColumn("_h", F.col("_nu") / F.col("_rho") - 1)
    east = F.expr(
        """_nu * _c * _d + _nu / 6 * pow(_c * _d, 3) * (_nu / _rho - _t2)
           + _nu / 120 * pow(_c * _d, 5) * (5 - 18 * _t2 + _t2 * _t2 + 14 * _h - 58 * _t2 * _h)"""
    )
    north = F.expr(
        """_arc + _nu * _s * _c * _d * _d / 2 + _nu / 24 * _s * pow(_c, 3) * (5 - _t2 + 9 * _h) * pow(_d, 4)
           + _nu / 720 * _s * pow(_c, 5) * (61 - 58 * _t2 + _t2 * _t2) * pow(_d, 6)"""
    )
    return df.withColumns({"easting": FALSE_EAST + east, "northing": FALSE_NORTH + north}).select(
        *keep, "easting", "northing"
    )
