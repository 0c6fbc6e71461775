"""Raster decoding and zonal fractions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.grid import to_grid_metres
from ..operators import raster as R
from ..operators import spatial as S
from .base import area_expr, edge_cte, load_input, query, rings, sql

DECODE = """d AS (SELECT *, (r - 85) * (r - 85) + (g - 91) * (g - 91) + (b - 157) * (b - 157) AS d0,
      (r - 154) * (r - 154) + (g - 159) * (g - 159) + (b - 222) * (b - 222) AS d1,
      (r - 195) * (r - 195) + (g - 224) * (g - 224) + (b - 255) * (b - 255) AS d2 FROM pixels),
    dec AS (SELECT *, CASE WHEN d0 <= least(d1, d2) THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS nearest, a > 16 AS low FROM d)"""


@query("p8_decode_legend", sql("pixels", DECODE + """
    SELECT tile_id, layer, nearest, count(*) AS pixels, count(*) FILTER (low) AS low, count(*) FILTER (low AND nearest <= 1) AS high
    FROM dec GROUP BY tile_id, layer, nearest"""))
def decode(spark, sf):
    return R.decode_legend(load_input(spark, sf, "pixels")).groupBy("tile_id", "layer", "nearest").agg(
        F.count("*").alias("pixels"), F.count_if("low").alias("low"), F.count_if("high").alias("high")
    )


@query("p9_pixel_to_xy", sql(["pixels", "tiles"], """
    SELECT tile_id, layer, px_row, px_col, minx + (px_col + 5e-1) * 1 AS x, maxy - (px_row + 5e-1) * 1 AS y
    FROM pixels JOIN tiles USING (tile_id)"""))
def to_xy(spark, sf):
    px = load_input(spark, sf, "pixels").join(load_input(spark, sf, "tiles"), "tile_id")
    return R.pixel_to_xy(px, 1.0).select("tile_id", "layer", "px_row", "px_col", "x", "y")


@query("p10_filter_risk_band", """SELECT l_suppkey AS tile_id, count(*) AS low,
    count(*) FILTER (l_returnflag IN ('A', 'R')) AS high FROM lineitem GROUP BY l_suppkey""")
def risk_band(spark, sf):
    from ..functions.rules import in_risk_band

    px = load_input(spark, sf, "lineitem").selectExpr("l_suppkey AS tile_id", "l_returnflag AS risk")
    return px.groupBy("tile_id").agg(
        F.count("*").alias("low"), F.count_if(in_risk_band("risk", ["A", "R"])).alias("high")
    )


ZONAL = DECODE + """,
    m AS (SELECT tile_id, px_row, px_col, bool_or(low) AS low, bool_or(low AND nearest <= 1) AS high FROM dec GROUP BY 1, 2, 3),
    p AS (SELECT m.*, minx + (px_col + 5e-1) AS x, maxy - (px_row + 5e-1) AS y FROM m JOIN tiles USING (tile_id) WHERE low),
    """ + edge_cte("e", "district_corners", "district_id") + """,
    hit AS (SELECT e.district_id, p.tile_id, px_row, px_col, bool_or(low) AS low, bool_or(high) AS high FROM p JOIN e
      ON ((xs <= x AND x < xe) OR (xe <= x AND x < xs)) AND ys + (ye - ys) * (x - xs) / (xe - xs) > y
      GROUP BY 1, 2, 3, 4 HAVING count(*) % 2 = 1),
    f AS (SELECT district_id, count(*) FILTER (high) * 1e0 AS h, count(*) FILTER (low) * 1e0 AS l FROM hit GROUP BY district_id)"""


def zonal(spark, sf):
    px = R.decode_legend(load_input(spark, sf, "pixels")).groupBy("tile_id", "px_row", "px_col").agg(
        F.bool_or("low").alias("low"), F.bool_or("high").alias("high")
    )
    px = R.pixel_to_xy(px.where("low").join(load_input(spark, sf, "tiles"), "tile_id"), 1.0)
    d = rings(load_input(spark, sf, "district_corners"))
    located = S.points_in_polygons(px.select("x", "y", "low", "high"), d, "district_id", 30.0)
    areas = d.select("district_id", S.ring_area().alias("area"))
    return R.pixel_fraction(located, areas, "district_id", 1.0, ["high", "low"])


@query("g5_pixel_fraction", sql(["pixels", "tiles", "district_corners"], ZONAL + f"""
    SELECT d.district_id, round(coalesce(h, 0) / ({area_expr()}), 4) AS high, round(coalesce(l, 0) / ({area_expr()}), 4) AS low
    FROM district_corners d LEFT JOIN f ON d.district_id = f.district_id"""))
def fraction(spark, sf):
    return zonal(spark, sf).select(
        "district_id", F.round("high", 4).alias("high"), F.round("low", 4).alias("low")
    )


@query("g6_mask_union", sql("pixels", """
    SELECT tile_id, count(*) AS painted FROM (SELECT DISTINCT tile_id, px_row, px_col FROM pixels WHERE a > 16) x GROUP BY tile_id"""))
def mask(spark, sf):
    px = R.decode_legend(load_input(spark, sf, "pixels"))
    return R.mask_union(px, "low").groupBy("tile_id").agg(F.count("*").alias("painted"))


# The oracle spells the published projection out again, step by step.
GEO = """g AS (SELECT vec_id AS point_id, -2 + 4 * CAST(embedding[1] AS DOUBLE) AS lon, 53 + 8 * CAST(embedding[2] AS DOUBLE) AS lat FROM embeddings)"""
PROJECT = GEO + """,
    a AS (SELECT point_id, radians(lat) AS f, radians(lon) AS l, 6378137e0 AS a, 1 - pow(63567523142e-4 / 6378137e0, 2) AS e2 FROM g),
    b AS (SELECT *, a / sqrt(1 - e2 * sin(f) * sin(f)) AS nu FROM a),
    c AS (SELECT point_id, nu * cos(f) * cos(l) AS x, nu * cos(f) * sin(l) AS y, (1 - e2) * nu * sin(f) AS z FROM b),
    h AS (SELECT point_id, -446448e-3 + (1 + 204894e-10) * x - radians(-8421e-4 / 3600) * y + radians(-247e-3 / 3600) * z AS x,
            125157e-3 + radians(-8421e-4 / 3600) * x + (1 + 204894e-10) * y - radians(-1502e-4 / 3600) * z AS y,
            -542060e-3 - radians(-247e-3 / 3600) * x + radians(-1502e-4 / 3600) * y + (1 + 204894e-10) * z AS z FROM c),
    i AS (SELECT point_id, atan2(y, x) AS l, sqrt(x * x + y * y) AS p, z, 6377563396e-3 AS a, 1 - pow(6356256909e-3 / 6377563396e-3, 2) AS e2 FROM h),
    j0 AS (SELECT *, atan2(z, p * (1 - e2)) AS f FROM i),
    j1 AS (SELECT * REPLACE (atan2(z + e2 * a / sqrt(1 - e2 * sin(f) * sin(f)) * sin(f), p) AS f) FROM j0),
    j2 AS (SELECT * REPLACE (atan2(z + e2 * a / sqrt(1 - e2 * sin(f) * sin(f)) * sin(f), p) AS f) FROM j1),
    j3 AS (SELECT * REPLACE (atan2(z + e2 * a / sqrt(1 - e2 * sin(f) * sin(f)) * sin(f), p) AS f) FROM j2),
    j AS (SELECT * REPLACE (atan2(z + e2 * a / sqrt(1 - e2 * sin(f) * sin(f)) * sin(f), p) AS f) FROM j3),
    k AS (SELECT point_id, f, l - radians(-2e0) AS d, 9996012717e-10 * a AS af, e2, radians(49e0) AS f0,
            (6377563396e-3 - 6356256909e-3) / (6377563396e-3 + 6356256909e-3) AS n, 9996012717e-10 * 6356256909e-3 AS bf FROM j),
    m AS (SELECT *, af / sqrt(1 - e2 * sin(f) * sin(f)) AS nu, af * (1 - e2) / pow(1 - e2 * sin(f) * sin(f), 15e-1) AS rho, tan(f) AS t,
        bf * ((1 + n + 125e-2 * n * n + 125e-2 * n * n * n) * (f - f0) - (3 * n + 3 * n * n + 2625e-3 * n * n * n) * sin(f - f0) * cos(f + f0)
          + (1875e-3 * n * n + 1875e-3 * n * n * n) * sin(2 * (f - f0)) * cos(2 * (f + f0)) - 35e0 / 24 * n * n * n * sin(3 * (f - f0)) * cos(3 * (f + f0))) AS arc FROM k),
    o AS (SELECT *, nu / rho - 1 AS eta2, cos(f) AS c FROM m)
    SELECT point_id,
      round(400000 + nu * c * d + nu / 6 * pow(c, 3) * (nu / rho - t * t) * pow(d, 3)
        + nu / 120 * pow(c, 5) * (5 - 18 * t * t + pow(t, 4) + 14 * eta2 - 58 * t * t * eta2) * pow(d, 5), 3) AS easting,
      round(-100000 + arc + nu / 2 * sin(f) * c * d * d + nu / 24 * sin(f) * pow(c, 3) * (5 - t * t + 9 * eta2) * pow(d, 4)
        + nu / 720 * sin(f) * pow(c, 5) * (61 - 58 * t * t + pow(t, 4)) * pow(d, 6), 3) AS northing FROM o"""


@query("p12_to_grid_metres", "WITH " + PROJECT)
def grid_metres(spark, sf):
    g = load_input(spark, sf, "embeddings").selectExpr(
        "vec_id AS point_id", "-2 + 4 * CAST(embedding[0] AS DOUBLE) AS lon", "53 + 8 * CAST(embedding[1] AS DOUBLE) AS lat"
    )
    return to_grid_metres(g, "lon", "lat").select(
        "point_id", F.round("easting", 3).alias("easting"), F.round("northing", 3).alias("northing")
    )


@query("p11_detect_lonlat", """SELECT 'lonlat' AS layer, max(abs(CAST(embedding[1] AS DOUBLE))) <= 180 AS is_lonlat FROM embeddings
    UNION ALL SELECT 'grid', max(abs(o_totalprice)) <= 180 FROM orders""")
def lonlat(spark, sf):
    from ..functions.rules import detect_lonlat

    a = load_input(spark, sf, "embeddings").selectExpr("'lonlat' AS layer", "CAST(embedding[0] AS DOUBLE) AS x")
    b = load_input(spark, sf, "orders").selectExpr("'grid' AS layer", "o_totalprice AS x")
    return a.unionAll(b).groupBy("layer").agg(detect_lonlat("x").alias("is_lonlat"))
