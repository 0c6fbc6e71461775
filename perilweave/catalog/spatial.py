"""Polygon overlay, point location and nearest-neighbour queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..operators import nearest as N
from ..operators import ordering as O
from ..operators import spatial as S
from .base import area_expr, edge_cte, load_input, overlap_cte, query, rings, sql

CELL = 30.0


def districts(spark, sf):
    return rings(load_input(spark, sf, "district_corners"))


def zones(spark, sf):
    return rings(load_input(spark, sf, "zone_corners"))


def regions(spark, sf):
    return rings(load_input(spark, sf, "region_corners"))


OVERLAY = overlap_cte("ov", "district_corners", "zone_corners", "district_id", "zone_id")
DZ = ["district_corners", "zone_corners"]


@query("j5_overlay_area", sql(DZ, OVERLAY + """
    SELECT district_id, zone_id, round(overlap, 4) AS overlap FROM ov"""))
def overlay(spark, sf):
    ov = S.overlay_area(districts(spark, sf), zones(spark, sf), "district_id", "zone_id", CELL)
    return ov.withColumn("overlap", F.round("overlap", 4))


@query("f12_geometry_measures", sql("district_corners", f"""
    SELECT district_id, round({area_expr()}, 4) AS area, round(least(x1, x2, x3, x4), 4) AS minx,
      round(least(y1, y2, y3, y4), 4) AS miny, round(greatest(x1, x2, x3, x4), 4) AS maxx,
      round(greatest(y1, y2, y3, y4), 4) AS maxy FROM district_corners"""))
def measures(spark, sf):
    d = S.with_bbox(districts(spark, sf))
    return d.select(
        "district_id", F.round(S.ring_area(), 4).alias("area"),
        *[F.round(c, 4).alias(c) for c in ("minx", "miny", "maxx", "maxy")],
    )


@query("f13_interior_point", sql("district_corners", edge_cte("e", "district_corners", "district_id") + """,
    mid AS (SELECT district_id, (least(y1, y2, y3, y4) + greatest(y1, y2, y3, y4)) / 2 AS y FROM district_corners),
    hit AS (SELECT e.district_id, m.y, xs + (xe - xs) * (m.y - ys) / (ye - ys) AS x
            FROM e JOIN mid m ON e.district_id = m.district_id
            WHERE (ys <= m.y AND m.y < ye) OR (ye <= m.y AND m.y < ys))
    SELECT district_id, round((min(x) + max(x)) / 2, 4) AS x, round(min(y), 4) AS y FROM hit GROUP BY district_id"""))
def interior(spark, sf):
    p = S.interior_points(districts(spark, sf), "district_id")
    return p.select("district_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


SUSC = """CASE kind WHEN 'ECONOMY' THEN 1e0 WHEN 'LARGE' THEN 7e-1 WHEN 'MEDIUM' THEN 45e-2
    WHEN 'PROMO' THEN 4e-1 WHEN 'SMALL' THEN 25e-2 ELSE 8e-2 END"""


def overlay_scored(spark, sf):
    z = zones(spark, sf).withColumn("susc", F.expr(SUSC))
    ov = S.overlay_area(districts(spark, sf), z, "district_id", "zone_id", CELL)
    return ov.join(z.select("zone_id", "kind", "susc"), "zone_id")


@query("g1_area_weighted_mean", sql(DZ, OVERLAY + f""",
    z AS (SELECT zone_id, {SUSC} AS susc FROM zone_corners)
    SELECT district_id, round(sum(overlap * susc) / sum(overlap), 4) AS score, CAST(count(*) AS BIGINT) AS pieces
    FROM ov JOIN z USING (zone_id) GROUP BY district_id"""))
def area_mean(spark, sf):
    return overlay_scored(spark, sf).groupBy("district_id").agg(
        F.round(S.area_weighted_mean(None, None, "susc"), 4).alias("score"),
        F.count(F.lit(1)).alias("pieces"),
    )


@query("g2_cover_fraction", sql(DZ, OVERLAY + f""",
    z AS (SELECT zone_id FROM zone_corners WHERE kind IN ('ECONOMY', 'LARGE')),
    d AS (SELECT district_id, {area_expr()} AS area FROM district_corners)
    SELECT d.district_id, round(least(coalesce(sum(overlap), 0) / greatest(max(area), 1), 1), 4) AS cover
    FROM d LEFT JOIN (SELECT district_id, overlap FROM ov JOIN z USING (zone_id)) o ON d.district_id = o.district_id
    GROUP BY d.district_id"""))
def cover(spark, sf):
    d = districts(spark, sf).select("district_id", S.ring_area().alias("area"))
    kept = overlay_scored(spark, sf).where("kind IN ('ECONOMY', 'LARGE')").groupBy("district_id").agg(
        F.sum("overlap").alias("overlap")
    )
    return d.join(kept, "district_id", "left").fillna(0.0, ["overlap"]).groupBy("district_id").agg(
        F.round(S.cover_fraction(F.max("area")), 4).alias("cover")
    )


@query("g3_dominant_category", sql(DZ, OVERLAY + f""",
    z AS (SELECT zone_id, kind, {SUSC} AS susc FROM zone_corners),
    k AS (SELECT district_id, kind, zone_id, round(overlap, 6) AS w FROM ov JOIN z USING (zone_id) WHERE susc >= 4e-1),
    r AS (SELECT *, row_number() OVER (PARTITION BY district_id ORDER BY w DESC, zone_id DESC) AS rn FROM k)
    SELECT d.district_id, coalesce(r.kind, 'none (low-plasticity bedrock)') AS dominant
    FROM district_corners d LEFT JOIN r ON d.district_id = r.district_id AND rn = 1"""))
def dominant(spark, sf):
    w = F.when(F.col("susc") >= 0.4, F.round("overlap", 6)).otherwise(0.0)
    best = overlay_scored(spark, sf).groupBy("district_id").agg(
        S.dominant_category("kind", w, F.col("zone_id")).alias("dominant")
    )
    return districts(spark, sf).select("district_id").join(best, "district_id", "left").fillna(
        "none (low-plasticity bedrock)", ["dominant"]
    )


def stations(spark, sf):
    return load_input(spark, sf, "grid").select("point_id", "x", "y")


@query("j6_points_in_polygons", sql(["grid", "district_corners"], edge_cte("e", "district_corners", "district_id") + """
    SELECT point_id, district_id FROM grid JOIN e
      ON ((xs <= x AND x < xe) OR (xe <= x AND x < xs)) AND ys + (ye - ys) * (x - xs) / (xe - xs) > y
    GROUP BY point_id, district_id HAVING count(*) % 2 = 1"""))
def located(spark, sf):
    return S.points_in_polygons(
        stations(spark, sf), districts(spark, sf), "district_id", CELL
    ).select("point_id", "district_id")


@query("j7_tiles_touching", sql(["tiles", "zone_corners"], """
    SELECT tile_id, minx, miny FROM tiles t WHERE EXISTS (SELECT 1 FROM zone_corners
      WHERE kind = 'PROMO' AND t.minx <= greatest(x1, x2, x3, x4) AND least(x1, x2, x3, x4) <= t.maxx
        AND t.miny <= greatest(y1, y2, y3, y4) AND least(y1, y2, y3, y4) <= t.maxy)"""))
def touching(spark, sf):
    promo = zones(spark, sf).where("kind = 'PROMO'")
    return S.tiles_touching(load_input(spark, sf, "tiles"), promo, CELL).select("tile_id", "minx", "miny")


def centres(spark, sf):
    return load_input(spark, sf, "district_corners").selectExpr(
        "district_id", "(x1 + x3) / 2 AS x", "(y2 + y4) / 2 AS y"
    )


KNN = """c AS (SELECT district_id, (x1 + x3) / 2 AS x, (y2 + y4) / 2 AS y FROM district_corners),
    dist AS (SELECT district_id, point_id, sqrt((c.x - g.x) * (c.x - g.x) + (c.y - g.y) * (c.y - g.y)) AS d
             FROM c CROSS JOIN grid g),
    nn AS (SELECT *, row_number() OVER (PARTITION BY district_id ORDER BY d, point_id) AS rn FROM dist)"""


@query("j8_knn_join", sql(["district_corners", "grid"], KNN + """
    SELECT district_id, point_id, round(d, 4) AS distance, CAST(rn AS INT) AS nth FROM nn WHERE rn <= 4"""))
def knn(spark, sf):
    nn = N.knn_join(centres(spark, sf), stations(spark, sf), "district_id", "point_id", 4)
    return nn.select(
        "district_id", "point_id", F.round("distance", 4).alias("distance"), F.col("rank").alias("nth")
    )


@query("j9_nearest_fallback", sql(DZ, OVERLAY.replace("FROM district_corners a JOIN zone_corners b",
        "FROM district_corners a JOIN (SELECT * FROM zone_corners WHERE layer = 'Brand#7') b") + """,
    z AS (SELECT * FROM zone_corners WHERE layer = 'Brand#7'),
    lone AS (SELECT * FROM district_corners WHERE district_id NOT IN (SELECT district_id FROM ov)),
    """ + edge_cte("le", "lone", "district_id") + ", " + edge_cte("ze", "z", "zone_id") + """,
    seg AS (SELECT l.district_id, e.zone_id, l.xs AS px, l.ys AS py, e.xs AS ax, e.ys AS ay, e.xe AS bx, e.ye AS by_ FROM le l CROSS JOIN ze e
      UNION ALL SELECT l.district_id, e.zone_id, e.xs, e.ys, l.xs, l.ys, l.xe, l.ye FROM le l CROSS JOIN ze e),
    f AS (SELECT *, least(greatest(((px - ax) * (bx - ax) + (py - ay) * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)), 0e0), 1e0) AS t FROM seg),
    g AS (SELECT district_id, zone_id, min(sqrt(pow(px - ax - t * (bx - ax), 2) + pow(py - ay - t * (by_ - ay), 2))) AS d FROM f GROUP BY district_id, zone_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY district_id ORDER BY d, zone_id) AS rn FROM g)
    SELECT district_id, zone_id, round(d, 4) AS distance FROM r WHERE rn = 1"""))
def fallback(spark, sf):
    d = districts(spark, sf)
    sparse = zones(spark, sf).where("layer = 'Brand#7'")
    hit = S.overlay_area(d, sparse, "district_id", "zone_id", CELL).select("district_id")
    lonely = d.join(hit, "district_id", "left_anti")
    near = N.nearest_polygon(lonely, sparse, "district_id", "zone_id")
    return near.withColumn("distance", F.round("distance", 4))


@query("j10_assign_majority", sql(["district_corners", "region_corners"],
       overlap_cte("ov", "district_corners", "region_corners", "district_id", "region_id") + f""",
    s AS (SELECT district_id, country, sum(overlap) AS shared FROM ov JOIN region_corners USING (region_id) GROUP BY district_id, country),
    r AS (SELECT *, row_number() OVER (PARTITION BY district_id ORDER BY shared DESC, country) AS rn,
            count(*) OVER (PARTITION BY district_id) AS n FROM s),
    d AS (SELECT district_id, {area_expr()} AS area FROM district_corners)
    SELECT district_id, country, round(CASE WHEN n = 1 THEN 1e0 ELSE shared / area END, 4) AS share
    FROM r JOIN d USING (district_id) WHERE rn = 1"""))
def majority(spark, sf):
    m = S.assign_majority(
        districts(spark, sf), regions(spark, sf), "district_id", "region_id", "country", CELL
    )
    return m.withColumn("share", F.round("share", 4))


FRONT = """SELECT p_partkey AS zone_id, CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_size - 5e0 END AS shape_leng,
    p_retailprice / 1000 - 1 AS recession FROM {part}"""


@query("j12_allocate_proportional", sql(DZ, overlap_cte("ov", "zone_corners", "district_corners", "zone_id", "district_id") + f""",
    q AS (SELECT zone_id, greatest(coalesce(shape_leng, 0), 0) * greatest(recession, 0) AS q FROM ({FRONT.replace('{part}', 'part')}) x),
    za AS (SELECT zone_id, {area_expr()} AS za FROM zone_corners),
    l AS (SELECT district_id, sum(q * overlap / za) AS lost FROM ov JOIN q USING (zone_id) JOIN za USING (zone_id)
          WHERE q > 0 GROUP BY district_id),
    d AS (SELECT district_id, {area_expr()} AS area FROM district_corners)
    SELECT d.district_id, round(coalesce(lost, 0), 4) AS lost, round(least(coalesce(lost, 0) / area, 1), 4) AS fraction
    FROM d LEFT JOIN l ON d.district_id = l.district_id"""))
def allocate(spark, sf):
    front = spark.sql(FRONT, part=load_input(spark, sf, "part"))
    z = zones(spark, sf).join(front, "zone_id")
    out = S.allocate_proportional(
        z, districts(spark, sf), "zone_id", "district_id", "shape_leng", "recession", CELL
    )
    return out.select(
        "district_id", F.round("lost", 4).alias("lost"), F.round("fraction", 4).alias("fraction")
    )


@query("j17_points_near_area", sql(["grid", "district_corners"], edge_cte("e", "district_corners", "district_id") + """,
    near AS (SELECT DISTINCT point_id FROM (
      SELECT point_id, x, y, xs, ys, xe, ye,
        least(greatest(((x - xs) * (xe - xs) + (y - ys) * (ye - ys)) / (pow(xe - xs, 2) + pow(ye - ys, 2)), 0e0), 1e0) AS t
      FROM grid CROSS JOIN e) k WHERE sqrt(pow(x - xs - t * (xe - xs), 2) + pow(y - ys - t * (ye - ys), 2)) <= 4e0),
    ins AS (SELECT point_id FROM grid JOIN e
      ON ((xs <= x AND x < xe) OR (xe <= x AND x < xs)) AND ys + (ye - ys) * (x - xs) / (xe - xs) > y
      GROUP BY point_id, district_id HAVING count(*) % 2 = 1)
    SELECT point_id, round(x, 4) AS x, round(y, 4) AS y FROM grid
    WHERE point_id IN (SELECT point_id FROM near UNION SELECT point_id FROM ins)"""))
def near_area(spark, sf):
    kept = N.points_near_area(stations(spark, sf), districts(spark, sf), 4.0, CELL)
    return kept.select("point_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("w5_equal_area_cuts", sql("district_corners", f"""
    d AS (SELECT district_id, (least(y1, y2, y3, y4) + greatest(y1, y2, y3, y4)) / 2 AS y, {area_expr()} AS area FROM district_corners),
    c AS (SELECT y, sum(area) OVER (ORDER BY y, district_id) / sum(area) OVER () AS cum FROM d)
    SELECT round(min(CASE WHEN cum >= 25e-2 THEN y END), 4) AS cut_25, round(min(CASE WHEN cum >= 5e-1 THEN y END), 4) AS cut_50,
      round(min(CASE WHEN cum >= 75e-2 THEN y END), 4) AS cut_75 FROM c"""))
def cuts(spark, sf):
    d = S.with_bbox(districts(spark, sf)).select(
        "district_id", F.expr("(miny + maxy) / 2").alias("y"), S.ring_area().alias("area")
    )
    return O.equal_area_cuts(d, "y", "area", "district_id").select(
        *[F.round(c, 4).alias(c) for c in ("cut_25", "cut_50", "cut_75")]
    )
