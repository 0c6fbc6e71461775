"""Polygon joins on plain arrays of corners, as equi-joins on tiles.

A polygon is ``rings ARRAY<ARRAY<STRUCT<x, y>>>``: outer rings run
counter-clockwise, holes clockwise. Layers meet through the tiles of their
boxes or of their cut edges (``tiles``), so every join is an equi-join with a
residual filter, and no join has a polygon alone as its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .tiles import BOX, PIECE, box_ctes, met_ctes, point_ctes, polygon_ctes, quoted, winding_sql

def ring_area(rings: str = "rings") -> Column:
    """Signed area under the edges; holes subtract themselves."""
    return F.expr(
        f"""aggregate({rings}, 0D, (total, ring) -> total + aggregate(
              sequence(0, size(ring) - 1), 0D, (acc, i) -> acc
              + (ring[i].x - ring[(i + 1) % size(ring)].x)
              * (ring[i].y + ring[(i + 1) % size(ring)].y) / 2))"""
    )


def with_bbox(df: DataFrame, rings: str = "rings") -> DataFrame:
    flat = F.flatten(F.col(rings))
    return df.withColumns(
        {
            "minx": F.array_min(flat["x"]),
            "miny": F.array_min(flat["y"]),
            "maxx": F.array_max(flat["x"]),
            "maxy": F.array_max(flat["y"]),
        }
    )


def dealt(polys: DataFrame, key: str) -> DataFrame:
    """Polygons with their boxes, dealt to all tasks by number: cutting one costs far more than its bytes tell."""
    parts = max(int(polys.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    # by a digest, so that nothing later takes the polygon for the key by which its pieces lie together
    return with_bbox(polys.repartition(parts, F.xxhash64(key)))


def edges(df: DataFrame, key: str, rings: str = "rings") -> DataFrame:
    """One row per edge with nonzero length."""
    ring = df.select(key, F.explode(rings).alias("_ring"))
    corner = ring.select(key, "_ring", F.posexplode("_ring").alias("_pos", "_at"))
    after = F.col("_ring")[(F.col("_pos") + 1) % F.size("_ring")]
    return corner.select(
        key,
        F.col("_at.x").alias("x1"),
        F.col("_at.y").alias("y1"),
        after["x"].alias("x2"),
        after["y"].alias("y2"),
    ).where("x1 <> x2 OR y1 <> y2")


# Overlaps below this share of the smaller box are rounding: polygons that only touch.
TOUCHING = 1e-12


def overlay_area(a: DataFrame, b: DataFrame, a_id: str, b_id: str, cell: float) -> DataFrame:
    """Area each overlapping pair shares, in one row per pair.

    Polygons meet tile by tile, each at its own level (``tiles``). Inside the
    smaller of two tiles the shared area is the sum over pairs of pieces that
    meet in x of the area under the lower of the two, above the tile's lower
    border. Every positive overlap is kept down to what double precision tells
    from touching (TOUCHING of the smaller box).
    """
    meet = """a_xa < b_xb AND b_xa < a_xb AND a_minx < b_maxx AND b_minx < a_maxx AND a_miny < b_maxy AND b_miny < a_maxy
        AND greatest(a_ya, a_yb) > b_cy * b_s AND greatest(b_ya, b_yb) > a_cy * a_s"""
    # f is the piece of the smaller tile, c that of the larger one.
    sides = ", ".join(
        f"IF(a_finer = {finer}, a_{c}, b_{c}) AS {p}{c}" for p, finer in (("f", "true"), ("c", "false")) for c in ("xa", "xb", "ya", "yb")
    )
    height = lambda p, x: f"{p}ya - base + ({p}yb - {p}ya) * ({x} - {p}xa) / ({p}xb - {p}xa)"
    return a.sparkSession.sql(
        f"""WITH {polygon_ctes("ta", "{a}", [a_id], cell)}, {polygon_ctes("tb", "{b}", [b_id], cell)},
          {met_ctes("met", "ta", "tb", [a_id, *BOX, *PIECE], [b_id, *BOX, *PIECE], meet)},
          sided AS (
            SELECT `a_{a_id}`, `b_{b_id}`, a_w * b_w AS w, {sides}, IF(a_finer, a_cy * a_s, b_cy * b_s) AS base,
              least((a_maxx - a_minx) * (a_maxy - a_miny), (b_maxx - b_minx) * (b_maxy - b_miny)) AS box,
              greatest(a_xa, b_xa) AS lo, least(a_xb, b_xb) AS hi FROM met),
          heights AS (SELECT *, {height("c", "lo")} AS g0, {height("c", "hi")} AS g1 FROM sided),
          -- the larger tile's piece may dip below the smaller tile: only its part above counts
          raised AS (
            SELECT * EXCEPT (lo, hi, g0, g1), IF(g0 < 0, lo + (hi - lo) * g0 / (g0 - g1), lo) AS lo,
              IF(g1 < 0, lo + (hi - lo) * g0 / (g0 - g1), hi) AS hi, greatest(g0, 0D) AS g0, greatest(g1, 0D) AS g1
            FROM heights WHERE g0 > 0 OR g1 > 0),
          apart AS (
            SELECT *, greatest(hi - lo, 0D) AS wide, {height("f", "lo")} - g0 AS d0, {height("f", "hi")} - g1 AS d1 FROM raised),
          shared AS (
            SELECT `a_{a_id}` AS `{a_id}`, `b_{b_id}` AS `{b_id}`, min(box) AS box, sum(w * wide * ((g0 + g1) / 2 + CASE
                WHEN d0 <= 0 AND d1 <= 0 THEN (d0 + d1) / 2
                WHEN d0 >= 0 AND d1 >= 0 THEN 0D
                WHEN d0 < 0 THEN d0 * d0 / (2 * (d0 - d1))
                ELSE d1 * d1 / (2 * (d1 - d0)) END)) AS overlap
            FROM apart GROUP BY 1, 2)
        SELECT `{a_id}`, `{b_id}`, overlap FROM shared WHERE overlap > {TOUCHING} * box""",
        a=dealt(a.select(a_id, "rings"), a_id), b=dealt(b.select(b_id, "rings"), b_id),
    )


def points_in_polygons(
    points: DataFrame, polys: DataFrame, key: str, cell: float, keep: list[str] | None = None
) -> DataFrame:
    """Pair each point (x, y) with the polygons that hold it.

    A point looks up its tile at each level the polygons have; the pieces of
    that tile alone tell its winding number, which is odd inside. The points
    are never shuffled when the tiles are small enough for Spark to broadcast.
    """
    columns = [key, *(keep or [])]
    return points.sparkSession.sql(
        f"""WITH {polygon_ctes("t", "{polys}", columns, cell)},
          tile AS (
            SELECT {quoted([*columns, "lv", "cx", "cy"])}, collect_list(struct({quoted(PIECE)})) AS pieces
            FROM t GROUP BY {quoted([*columns, *BOX, "lv", "cx", "cy"])}),
          {point_ctes("spot", "{points}", points.columns, "t_levels", cell)}
        SELECT {quoted(points.columns, "spot.")}, {quoted(columns, "tile.")} FROM spot JOIN tile ON spot.lv = tile.lv AND spot.cx = tile.cx AND spot.cy = tile.cy
        WHERE abs({winding_sql("tile.pieces", "spot.x", "spot.y")}) % 2 = 1""",
        polys=dealt(polys.select(*columns, "rings"), key), points=points,
    )


def tiles_touching(tiles: DataFrame, areas: DataFrame, cell: float) -> DataFrame:
    """Tiles (minx, miny, maxx, maxy) whose box meets the box of any area."""
    touch = "a_minx <= b_maxx AND b_minx <= a_maxx AND a_miny <= b_maxy AND b_miny <= a_maxy"
    found = tiles.sparkSession.sql(
        f"""WITH {box_ctes("tt", "{tiles}", ["tile_id", *BOX], cell)}, {box_ctes("ar", "{areas}", BOX, cell)},
          {met_ctes("met", "tt", "ar", ["tile_id", *BOX], BOX, touch, "LEFT SEMI JOIN")}
        SELECT DISTINCT a_tile_id AS tile_id FROM met""",
        tiles=tiles, areas=with_bbox(areas),
    )
    return tiles.join(found, "tile_id", "left_semi")


def interior_points(df: DataFrame, key: str, rings: str = "rings") -> DataFrame:
    """A point inside each polygon: middle of the widest span at half height."""
    mid = with_bbox(df, rings).select(key, ((F.col("miny") + F.col("maxy")) / 2).alias("y"))
    crossed = (
        edges(df, key, rings)
        .join(mid, key)
        .where("(y1 <= y AND y < y2) OR (y2 <= y AND y < y1)")
        .withColumn("x", F.expr("x1 + (x2 - x1) * (y - y1) / (y2 - y1)"))
    )
    w = Window.partitionBy(key).orderBy("x")
    spans = crossed.select(
        key, "y", "x", F.lead("x").over(w).alias("x_next"), F.row_number().over(w).alias("rn")
    ).where("rn % 2 = 1")
    return spans.groupBy(key).agg(
        F.max_by(F.expr("(x + x_next) / 2"), F.struct(F.expr("x_next - x"), F.expr("-x"))).alias("x"),
        F.first("y").alias("y"),
    )


def area_weighted_mean(pairs: DataFrame, by: str, value: str, weight: str = "overlap") -> Column:
    """Aggregate for ``groupBy``: mean of ``value`` weighted by area."""
    return F.try_divide(F.sum(F.col(weight) * F.col(value)), F.sum(weight))


def cover_fraction(area: Column, weight: str = "overlap") -> Column:
    """Aggregate for ``groupBy``: covered share of an area of at least 1."""
    return F.least(F.greatest(F.sum(weight) / F.greatest(area, F.lit(1.0)), F.lit(0.0)), F.lit(1.0))


def dominant_category(label: str, weight: Column, order: Column) -> Column:
    """Aggregate for ``groupBy``: label with the largest weight, later key on ties."""
    return F.max_by(F.when(weight > 0, F.col(label)), F.struct(weight, order))


def assign_majority(
    districts: DataFrame, regions: DataFrame, district_id: str, region_id: str, label: str, cell: float
) -> DataFrame:
    """Region with the largest share of each district, and that share.

    A district that touches one region belongs to it whole; one that overlaps
    none takes the region around its interior point, with share 0.
    """
    area = districts.select(district_id, ring_area().alias("area"))
    shares = (
        overlay_area(districts, regions, district_id, region_id, cell)
        .join(regions.select(region_id, label), region_id)
        .groupBy(district_id, label)
        .agg(F.sum("overlap").alias("shared"))
        .groupBy(district_id)
        .agg(
            F.min_by(label, F.struct(-F.col("shared"), F.col(label))).alias("_best"),
            F.max("shared").alias("_most"),
            F.count(F.lit(1)).alias("_n"),
        )
    )
    overlapped = area.join(shares, district_id, "left")
    lonely = overlapped.where("_best IS NULL").select(district_id)
    inside = points_in_polygons(
        interior_points(districts.join(lonely, district_id, "left_semi"), district_id),
        regions, region_id, cell, keep=[label],
    ).groupBy(district_id).agg(F.min(label).alias("_inside"))
    return overlapped.join(inside, district_id, "left").select(
        district_id,
        F.coalesce("_best", "_inside").alias(label),
        F.when(F.col("_n") == 1, 1.0)
        .otherwise(F.coalesce(F.col("_most") / F.greatest("area", F.lit(1e-9)), F.lit(0.0)))
        .alias("share"),
    )


def allocate_proportional(
    zones: DataFrame, districts: DataFrame, zone_id: str, district_id: str,
    length: str, depth: str, cell: float,
) -> DataFrame:
    """Spread length x depth of each zone over districts by shared area.

    Negative, missing and non-finite measures count as nothing lost.
    """
    finite = lambda c: F.when(
        F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.greatest(F.col(c), F.lit(0.0))
    ).otherwise(0.0)
    # A measure only counts when both of its parts are finite.
    quantity = finite(length) * finite(depth)
    z = zones.select(zone_id, quantity.alias("q"), ring_area().alias("zone_area")).where(
        "q > 0 AND zone_area > 0"
    )
    lost = (
        overlay_area(zones, districts, zone_id, district_id, cell)
        .join(z, zone_id)
        .groupBy(district_id)
        .agg(F.sum(F.expr("q * overlap / zone_area")).alias("lost"))
    )
    area = districts.select(district_id, ring_area().alias("area"))
    return area.join(lost, district_id, "left").select(
        district_id,
        F.coalesce("lost", F.lit(0.0)).alias("lost"),
        F.least(F.greatest(F.coalesce(F.col("lost"), F.lit(0.0)) / F.col("area"), F.lit(0.0)), F.lit(1.0)).alias("fraction"),
    )
