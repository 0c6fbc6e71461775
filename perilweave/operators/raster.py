"""Decoded raster tiles as pixel tables: one row per pixel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Legend colours of the three likelihood bands, most likely first,
# and the opacity above which a pixel counts as painted.
LEGEND = ((85, 91, 157), (154, 159, 222), (195, 224, 255))
PAINTED_ALPHA = 16


def _distance(colour: tuple[int, int, int]) -> Column:
    return sum(
        (F.col(c) - v) * (F.col(c) - v) for c, v in zip(("r", "g", "b"), colour)
    )


def decode_legend(pixels: DataFrame) -> DataFrame:
    """Flag painted pixels and those of the two more likely bands.

    A pixel belongs to the nearest legend colour; the first wins a tie.
    """
    d0, d1, d2 = (_distance(c) for c in LEGEND)
    nearest = F.when((d0 <= d1) & (d0 <= d2), 0).when(d1 <= d2, 1).otherwise(2)
    painted = F.col("a") > PAINTED_ALPHA
    return pixels.withColumns(
        {"nearest": nearest, "low": painted, "high": painted & (nearest <= 1)}
    )


def pixel_to_xy(pixels: DataFrame, px: float) -> DataFrame:
    """Centre of a pixel; rows count from the top of the tile."""
    return pixels.withColumns(
        {
            "x": F.col("minx") + (F.col("px_col") + 0.5) * px,
            "y": F.col("maxy") - (F.col("px_row") + 0.5) * px,
        }
    )


def mask_union(pixels: DataFrame, painted: str) -> DataFrame:
    """Pixels painted in at least one layer, each once."""
    return pixels.where(F.col(painted)).select("tile_id", "px_row", "px_col").distinct()


def pixel_fraction(located: DataFrame, districts: DataFrame, key: str, px: float, bands: list[str]) -> DataFrame:
    """Painted area of each band over district area; the wider band holds the narrower."""
    area = px * px
    counts = located.groupBy(key).agg(
        *[F.sum(F.when(F.col(b), area).otherwise(0.0)).alias(f"_{b}") for b in bands]
    )
    joined = districts.select(key, "area").join(counts, key, "left")
    return joined.select(
        key,
        *[
            F.least(F.coalesce(F.col(f"_{b}"), F.lit(0.0)) / F.col("area"), F.lit(1.0)).alias(b)
            for b in bands
        ],
    )
