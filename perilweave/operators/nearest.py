"""Exact nearest-neighbour joins over leaves of a few dozen items each.

Items are dealt into slabs of equal count by x and into leaves of equal count by
y, by exact ranks, so a cluster is parted as finely as any other region and no
leaf grows with the data, however the items lie. A target falls into a leaf as
if it were an item; the k-th distance to that leaf's items bounds its search.
The leaves whose boxes reach into the bound are found from above: two slabs by
two leaves make a node, two by two nodes the next, and only nodes that reach
into the bound are opened, so a target far from all items does not meet every
leaf. Only the items of those leaves are compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import materialize
from .ordering import running
from .tiles import BOX, box_ctes, point_ctes, quoted

LEAF_ROWS = 32


def _dealt(items: DataFrame, probes: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Items and probes (both with x, y) with their slab and leaf.

    A leaf has at least ``least`` and less than twice as many items, if there
    are so many at all. Probes count for nothing in the ranks.
    """
    tag = lambda df, own: df.select(F.struct(*df.columns).alias(own), "x", "y")
    both = tag(items.withColumn("one", F.lit(1)), "_item").unionByName(tag(probes, "_probe"), allowMissingColumns=True)
    both = both.withColumn("one", F.when(F.col("_item").isNotNull(), 1).otherwise(0))
    ranked = running(both.withColumn("_key", F.monotonically_increasing_id()), "x", "_key", rank=None, total_of="one", total="before")
    n = items.agg(F.count(F.lit(1)).alias("n")).scalar()
    # Slabs and leaves both end in one of up to twice the size, never in a small one.
    ranked = ranked.withColumn("_n", n).withColumn("_per", F.greatest(F.ceil(F.sqrt(F.col("_n") * F.lit(float(least)))), F.lit(least)))
    last = lambda count, size: F.greatest(F.floor(F.col(count) / size) - 1, F.lit(0))
    nth = lambda before, size: F.greatest(F.floor((F.col(before) - 1) / size), F.lit(0))
    ranked = ranked.withColumn("slab", F.least(nth("before", F.col("_per")), last("_n", F.col("_per"))))
    slab = Window.partitionBy("slab")
    upward = slab.orderBy("y", "_key").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranked.withColumns({"_up": F.sum("one").over(upward), "_m": F.sum("one").over(slab)})
    ranked = ranked.withColumn("leaf", F.least(nth("_up", F.lit(least)), last("_m", F.lit(least))))
    dealt = materialize(ranked.select("_item", "_probe", "slab", "leaf"), "leaves")
    out = [dealt.where(F.col(c).isNotNull()).select(f"{c}.*", "slab", "leaf") for c in ("_item", "_probe")]
    return out[0].drop("one"), out[1]


def near(items: DataFrame, probes: DataFrame, distance: str, k: int, bound_by: list[str]) -> DataFrame:
    """Pairs of a probe and an item that can be among the k nearest, with their ``distance``.

    ``items`` and ``probes`` have x, y (any point of theirs) and a box; their
    other columns have names of their own. ``distance`` is an SQL expression
    over both, with i. and p., at least the distance of the boxes. The bound of
    a search is the least of all probes that agree in ``bound_by``.
    """
    spark = items.sparkSession
    placed, asked = _dealt(items, probes, max(LEAF_ROWS, k))
    own = [c for c in items.columns if c not in (*BOX, "x", "y")]
    names = [c for c in probes.columns if c not in (*BOX, "x", "y")]
    asked = asked.withColumn("_probe_id", F.monotonically_increasing_id())
    bounded = materialize(
        spark.sql(
            f"""WITH met AS (
                SELECT p._probe_id, {distance} AS d FROM {{asked}} p JOIN {{placed}} i ON p.slab = i.slab AND p.leaf = i.leaf),
              kth AS (SELECT _probe_id, array_sort(collect_list(d)) AS ds FROM met GROUP BY _probe_id), -- a leaf's items
              bound AS (SELECT _probe_id, element_at(ds, CAST(least({k}, size(ds)) AS INT)) AS r FROM kth)
            SELECT p.*, min(r) OVER (PARTITION BY {quoted(bound_by, "p.")}) AS r FROM {{asked}} p JOIN bound USING (_probe_id)""",
            asked=materialize(asked, "probes"), placed=placed,
        ).drop("_probe_id"), "bounds",
    )
    # Rounding of the bound must not lose the item that set it.
    circles = bounded.selectExpr("* EXCEPT (r, minx, miny, maxx, maxy, slab, leaf)", "minx AS p_minx", "miny AS p_miny", "maxx AS p_maxx",
        "maxy AS p_maxy", "r * (1 + 1e-12) AS r").selectExpr("*", "p_minx - r AS minx", "p_miny - r AS miny", "p_maxx + r AS maxx", "p_maxy + r AS maxy")
    # A circle far from all items costs as much as thousands of bytes: dealt by number, not by size.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    reached = _reached(circles.distinct().repartition(parts, *names), placed).selectExpr(
        *[f"`{c}`" for c in (*names, "x", "y", "r", "slab", "leaf")], *[f"p_{c} AS {c}" for c in BOX]
    )
    # Boxes first: their distance costs a fraction of the exact one, and far targets meet whole leaves for one item.
    gap = lambda axis: f"greatest(i.min{axis} - p.max{axis}, p.min{axis} - i.max{axis}, 0D)"
    square = lambda v: f"{v} * {v}"
    rounding = "1e-12 * greatest(" + ", ".join(f"abs({c})" for c in BOX) + ")"
    return spark.sql(
        f"""SELECT * EXCEPT (apart, reach, r) FROM (
          SELECT {quoted(names, "p.")}, {quoted(own, "i.")}, {square(gap("x"))} + {square(gap("y"))} AS apart, {square("(p.wide + i.slack)")} AS reach, {distance} AS distance, p.r
          FROM (SELECT *, r * (1 + 1e-12) + {rounding} AS wide FROM {{reached}}) p
          JOIN (SELECT *, {rounding} AS slack FROM {{placed}}) i ON p.slab = i.slab AND p.leaf = i.leaf)
        WHERE apart <= reach AND distance <= r""",
        reached=reached, placed=placed,
    )


def _reached(circles: DataFrame, placed: DataFrame) -> DataFrame:
    """Circles (p_ box, r) with each leaf of ``placed`` whose box is no further away than r, once each."""
    top = placed.agg(F.max(F.greatest("slab", "leaf"))).first()[0] or 0
    depth = int(top).bit_length()
    up = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("up")
    nodes = placed.select("slab", "leaf", *BOX, up).groupBy(
        "up", F.expr("shiftright(slab, up)").alias("slab"), F.expr("shiftright(leaf, up)").alias("leaf")
    )
    tree = materialize(nodes.agg(*[(F.min if c[:3] == "min" else F.max)(c).alias(c) for c in BOX]), "boxes")
    gap = lambda axis: f"greatest(min{axis} - p_max{axis}, p_min{axis} - max{axis}, 0D)"
    kept = [c for c in circles.columns if c not in BOX]
    # not as constants, which would make the first join a product
    found = circles.selectExpr(*[f"`{c}`" for c in kept], "inline(array(struct(0L AS slab, 0L AS leaf)))")
    for level in reversed(range(depth)):
        below = tree.where(F.col("up") == level).selectExpr(
            "shiftright(slab, 1) AS slab", "shiftright(leaf, 1) AS leaf", "slab AS _slab", "leaf AS _leaf", *BOX
        )
        met = found.join(below, ["slab", "leaf"]).where(f"hypot({gap('x')}, {gap('y')}) <= r")
        found = met.selectExpr(*[f"`{c}`" for c in kept], "_slab AS slab", "_leaf AS leaf")
    return found


def knn_join(targets: DataFrame, points: DataFrame, target_id: str, point_id: str, k: int = 4) -> DataFrame:
    """The k nearest points of each target with their distance and rank, smaller id on ties."""
    # Copies of one place beyond the k-th can never be needed.
    spot = Window.partitionBy("x", "y").orderBy("_item")
    at = lambda df, p: df.selectExpr("*", f"x AS {p}x", f"y AS {p}y", "x AS minx", "y AS miny", "x AS maxx", "y AS maxy")
    items = points.select(F.col(point_id).alias("_item"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    items = items.withColumn("_c", F.row_number().over(spot)).where(F.col("_c") <= k).drop("_c")
    probes = targets.select(F.col(target_id).alias("_target"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    pairs = near(at(items, "i"), at(probes, "p"), "hypot(p.px - i.ix, p.py - i.iy)", k, ["_target"])
    w = Window.partitionBy("_target").orderBy("distance", "_item")
    return (
        pairs.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
        .select(F.col("_target").alias(target_id), F.col("_item").alias(point_id), "distance", "rank")
    )


def idw(neighbours: DataFrame, points: DataFrame, target_id: str, point_id: str, values: list[str]) -> DataFrame:
    """Inverse squared distance mean of each value, distances of at least 1."""
    weight = 1 / F.pow(F.greatest("distance", F.lit(1.0)), F.lit(2.0))
    return (
        neighbours.join(points.select(point_id, *values), point_id)
        .withColumn("_w", weight)
        .groupBy(target_id)
        .agg(*[(F.sum(F.col("_w") * F.col(v)) / F.sum("_w")).alias(v) for v in values])
    )


def nearest_polygon(lonely: DataFrame, polys: DataFrame, target_id: str, poly_id: str) -> DataFrame:
    """Nearest polygon of each given polygon, by boundary distance, smaller id on ties.

    Meant for districts that overlap no polygon of the layer. Both sides are
    edges with boxes: each edge of a target searches for itself, within the
    best bound that any edge of its target has found, so no polygon's edges
    meet all edges of another. The targets are written once, as the search
    reads them several times; the layer is only dealt if there are any.
    """
    from .spatial import edges

    lonely = materialize(lonely.select(target_id, "rings"), "lonely")
    if lonely.isEmpty():
        none = F.lit(None).cast(polys.schema[poly_id].dataType)
        return lonely.select(target_id, none.alias(poly_id), F.lit(None).cast("double").alias("distance"))

    def sides(df: DataFrame, key: str, p: str) -> DataFrame:
        return edges(df, key).selectExpr(
            f"`{key}` AS {p}_id", f"x1 AS {p}x1", f"y1 AS {p}y1", f"x2 AS {p}x2", f"y2 AS {p}y2", "(x1 + x2) / 2 AS x", "(y1 + y2) / 2 AS y",
            "least(x1, x2) AS minx", "least(y1, y2) AS miny", "greatest(x1, x2) AS maxx", "greatest(y1, y2) AS maxy",
        )

    def to_segment(px: str, py: str, ax: str, ay: str, bx: str, by: str) -> str:
        along = (
            f"least(greatest((({px}-{ax})*({bx}-{ax})+({py}-{ay})*({by}-{ay}))"
            f"/(pow({bx}-{ax},2)+pow({by}-{ay},2)),0D),1D)"
        )
        return f"hypot({px}-{ax}-{along}*({bx}-{ax}), {py}-{ay}-{along}*({by}-{ay}))"

    item, probe = ["i.ix1", "i.iy1", "i.ix2", "i.iy2"], ["p.px1", "p.py1", "p.px2", "p.py2"]
    distance = "least({}, {}, {}, {})".format(
        to_segment(*probe[:2], *item), to_segment(*probe[2:], *item), to_segment(*item[:2], *probe), to_segment(*item[2:], *probe)
    )
    pairs = near(sides(polys, poly_id, "i"), sides(lonely, target_id, "p"), distance, 1, ["p_id"])
    return pairs.groupBy(F.col("p_id").alias(target_id)).agg(
        F.min_by("i_id", F.struct("distance", "i_id")).alias(poly_id), F.min("distance").alias("distance")
    )


def points_near_area(grid: DataFrame, areas: DataFrame, distance: float, cell: float) -> DataFrame:
    """Grid points (point_id, x, y) inside an area or within ``distance`` of one."""
    from .spatial import edges, points_in_polygons

    key = areas.columns[0]
    sides = edges(areas, key).selectExpr(
        "x1", "y1", "x2", "y2", f"least(x1, x2) - {distance} AS minx", f"greatest(x1, x2) + {distance} AS maxx",
        f"least(y1, y2) - {distance} AS miny", f"greatest(y1, y2) + {distance} AS maxy",
    )
    along = (
        "least(greatest(((g.x-s.x1)*(s.x2-s.x1)+(g.y-s.y1)*(s.y2-s.y1))"
        "/(pow(s.x2-s.x1,2)+pow(s.y2-s.y1,2)),0D),1D)"
    )
    beside = grid.sparkSession.sql(
        f"""WITH {box_ctes("side", "{sides}", ["x1", "y1", "x2", "y2", *BOX], cell)},
          {point_ctes("spot", "{grid}", ["point_id", "x", "y"], "side_levels", cell)}
        SELECT g.point_id FROM spot g LEFT SEMI JOIN side s ON g.lv = s.lv AND g.cx = s.cx AND g.cy = s.cy
          AND hypot(g.x-s.x1-{along}*(s.x2-s.x1), g.y-s.y1-{along}*(s.y2-s.y1)) <= {float(distance)}D""",
        sides=sides, grid=grid,
    )
    inside = points_in_polygons(grid, areas, key, cell).select("point_id")
    return grid.join(beside.union(inside).distinct(), "point_id", "left_semi")
