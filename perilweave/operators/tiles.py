"""Boxes and polygons on square tiles, each at a level of its own size.

Level ``l`` has tiles of ``cell * 2^l``. A box takes the level at which it
touches at most four tiles; a polygon with many edges a finer one, with about
as many tiles as edges. Layers meet by equi-joins across levels: the finer side
looks up the tile that holds its own, at each level the other side has.

A tile holds all it takes to know a polygon inside it: its edges cut to the
tile, steps where they cross its upper border, and the winding number at its
upper left corner. Counting with their weights the pieces above a point gives
the winding number of that point, without the polygon's other edges.

The steps are common table expressions, so that a whole operator is one
statement and is analysed once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

BOX = ["minx", "miny", "maxx", "maxy"]
FINEST, COARSEST = -30, 60


def quoted(names: list[str], prefix: str = "") -> str:
    return ", ".join(f"{prefix}`{n}`" for n in names)


def level_sql(cell: float, tiles_a_side: str = "1") -> str:
    """The level at which a box (minx, miny, maxx, maxy) is at most so many tiles wide and high."""
    extent = "greatest(maxx - minx, maxy - miny)"
    found = f"CASE WHEN {extent} > 0 THEN ceil(log2({extent} / ({float(cell)}D * {tiles_a_side}))) ELSE {FINEST} END"
    return f"CAST(least(greatest({found}, {FINEST}), {COARSEST}) AS INT)"


def box_ctes(name: str, source: str, columns: list[str], cell: float) -> str:
    """``name``: a row for each of the at most four tiles that a box of ``source`` touches (lv, cx, cy)."""
    span = lambda a, b: f"sequence(CAST(floor({a} / s) AS BIGINT), CAST(floor({b} / s) AS BIGINT))"
    return f"""{name}_at AS (SELECT {quoted(columns)}, lv, {float(cell)}D * pow(2D, lv) AS s FROM (
        SELECT *, {level_sql(cell)} AS lv FROM {source})),
      {name} AS (SELECT {quoted(columns)}, lv, s, cx, cy FROM {name}_at
        LATERAL VIEW explode({span('minx', 'maxx')}) v AS cx LATERAL VIEW explode({span('miny', 'maxy')}) w AS cy),
      {name}_levels AS (SELECT collect_set(lv) AS lvs FROM {name}_at)"""


def point_ctes(name: str, source: str, columns: list[str], levels: str, cell: float) -> str:
    """``name``: points (x, y) with their tile at each of the levels, a hundred at most."""
    return f"""{name}_at AS (SELECT {quoted(columns)}, lv, {float(cell)}D * pow(2D, lv) AS s FROM (
        SELECT *, (SELECT lvs FROM {levels}) AS lvs FROM {source}) LATERAL VIEW explode(lvs) v AS lv),
      {name} AS (SELECT {quoted(columns)}, lv, floor(x / s) AS cx, floor(y / s) AS cy FROM {name}_at)"""


def met_ctes(name: str, a: str, b: str, columns_a: list[str], columns_b: list[str], condition: str, how: str = "JOIN") -> str:
    """``name``: rows of ``a`` and ``b`` whose tiles hold one another; a_ and b_ stand before the names.

    One equi-join: each row stands in its own tile, and in the tiles around it
    at the levels of the other side; rows meet where one of them is in its own.
    A row that no level of the other side looks up is not placed in its own.
    ``a_finer`` says that a's tile is not the larger. Rows are dealt by tile
    even if the other side is broadcast: one polygon can have most of them.
    """

    def placed(p: str, table: str, columns: list[str], others: str, above: str, below: str, own: str) -> str:
        named = ", ".join(f"`{c}` AS `{p}_{c}`" for c in dict.fromkeys([*columns, "lv", "s", "cx", "cy"]))
        lookups = f"transform(filter(lvs, v -> v {above} lv), v -> struct({own} = 'b' AS finer, v AS lv))"
        itself = f"filter(array(struct({own} = 'a' AS finer, lv AS lv)), e -> exists(lvs, v -> v {below} lv))"
        # a's rows look up larger or equal tiles of b as the finer side, b's rows only larger ones of a.
        return f"""{name}_{p} AS (
          SELECT /*+ REPARTITION(ty, tx, at, finer) */ * FROM (
            SELECT {named}, e.finer, e.lv AS at, shiftright(cx, e.lv - lv) AS tx, shiftright(cy, e.lv - lv) AS ty
            FROM (SELECT *, (SELECT lvs FROM {others}) AS lvs FROM {table}) LATERAL VIEW explode(concat({lookups}, {itself})) v AS e))"""

    return f"""{placed('a', a, columns_a, f'{b}_levels', '>=', '<', "'b'")},
      {placed('b', b, columns_b, f'{a}_levels', '>', '<=', "'a'")},
      {name} AS (SELECT {'a.*, b.*' if how == 'JOIN' else 'a.*'}, a.finer AS a_finer FROM {name}_a a {how} {name}_b b
        ON a.ty = b.ty AND a.tx = b.tx AND a.at = b.at AND a.finer = b.finer AND {condition})"""


def polygon_ctes(name: str, source: str, columns: list[str], cell: float, rings: str = "rings") -> str:
    """``name``: pieces of polygons by tile, from a table with ``rings`` and boxes.

    Columns: the kept ones, the box, lv, s, cx, cy, (xa, ya) to (xb, yb) and a
    weight w; the weights of the pieces above a point of the tile add up to the
    polygon's winding number there. ``name_levels`` has the levels.

    Edges are cut at the columns of tiles from left to right. A cut gives both
    parts the same height, and a part's row of tiles is decided by its end
    points alone, so neighbouring parts always agree about which borders the
    outline crosses. A height on a border belongs to the row below. Vertical
    edges weigh nothing, but step over borders. Corners of tiles take their
    winding number from a running sum over the crossings of their column, which
    has as many rows as the polygon has tiles on that line.
    """
    same = quoted([*columns, *BOX, "lv", "s"])
    corners = f"aggregate({rings}, 0, (n, r) -> n + size(r))"
    height = lambda x: f"CASE WHEN {x} <= lx THEN ly WHEN {x} >= rx THEN ry ELSE ly + (ry - ly) * ({x} - lx) / (rx - lx) END"
    crossing = lambda y: f"CASE WHEN ya = yb OR xa = xb THEN xa ELSE least(greatest(xa + (xb - xa) * ({y} - ya) / (yb - ya), xa), xb) END"
    return f"""{name}_at AS (
        SELECT {quoted([*columns, *BOX])}, {rings}, lv, {float(cell)}D * pow(2D, lv) AS s FROM (
          SELECT *, {level_sql(cell, f"greatest(floor(sqrt({corners}) / 2), 5e-1)")} AS lv FROM {source}
          WHERE maxx > minx AND maxy > miny)),
      {name}_levels AS (SELECT collect_set(lv) AS lvs FROM {name}_at),
      {name}_corner AS (
        SELECT {same}, at.x AS x1, at.y AS y1, ring[(pos + 1) % size(ring)].x AS x2, ring[(pos + 1) % size(ring)].y AS y2
        FROM {name}_at LATERAL VIEW explode({rings}) v AS ring LATERAL VIEW posexplode(ring) w AS pos, at),
      {name}_edge AS (
        SELECT {same}, least(x1, x2) AS lx, greatest(x1, x2) AS rx, IF(x1 > x2, y2, y1) AS ly, IF(x1 > x2, y1, y2) AS ry,
          CAST(signum(x1 - x2) AS INT) AS sgn, CAST(signum(y1 - y2) AS INT) AS down
        FROM {name}_corner WHERE x1 <> x2 OR y1 <> y2),
      {name}_strip AS (
        SELECT {same}, lx, rx, ly, ry, sgn, down, cx, IF(sgn = 0, lx, greatest(lx, cx * s)) AS xa, IF(sgn = 0, lx, least(rx, (cx + 1) * s)) AS xb
        FROM {name}_edge LATERAL VIEW explode(CASE WHEN sgn = 0 THEN array(ceil(lx / s) - 1)
          ELSE sequence(floor(lx / s), greatest(ceil(rx / s) - 1, floor(lx / s))) END) v AS cx),
      {name}_cut AS (
        SELECT *, ceil(ya / s) - 1 AS ra, ceil(yb / s) - 1 AS rb FROM (
          SELECT {same}, sgn, down, cx, xa, xb, IF(sgn = 0, ly, {height('xa')}) AS ya, IF(sgn = 0, ry, {height('xb')}) AS yb
          FROM {name}_strip WHERE sgn = 0 OR xa < xb)),
      {name}_row AS (
        SELECT *, {crossing('y0')} AS x_low, {crossing('y1')} AS x_high FROM (
          SELECT *, cy * s AS y0, (cy + 1) * s AS y1 FROM {name}_cut
          LATERAL VIEW explode(sequence(least(ra, rb), greatest(ra, rb))) v AS cy)),
      {name}_piece AS (
        SELECT {same}, cx, cy, p.* FROM {name}_row LATERAL VIEW explode(array(
          struct(
            CASE WHEN cy = ra THEN xa WHEN rb > ra THEN x_low ELSE x_high END AS xa,
            CASE WHEN cy = rb THEN xb WHEN rb > ra THEN x_high ELSE x_low END AS xb,
            CASE WHEN cy = ra THEN ya WHEN rb > ra THEN y0 ELSE y1 END AS ya,
            CASE WHEN cy = rb THEN yb WHEN rb > ra THEN y1 ELSE y0 END AS yb, sgn AS w),
          struct(x_high AS xa, (cx + 1) * s AS xb, y1 AS ya, y1 AS yb,
            CASE WHEN cy = greatest(ra, rb) THEN 0 WHEN sgn = 0 THEN down WHEN rb > ra THEN sgn ELSE -sgn END AS w))) v AS p),
      {name}_entering AS (
        SELECT {same}, cx, ra, sum(sgn) AS w FROM {name}_cut WHERE sgn <> 0 AND xa <= cx * s GROUP BY {same}, cx, ra),
      {name}_above AS (
        SELECT {same}, cx, ra, CAST(sum(w) OVER (PARTITION BY {same}, cx ORDER BY ra DESC) AS INT) AS w,
          lead(ra) OVER (PARTITION BY {same}, cx ORDER BY ra DESC) AS lower FROM {name}_entering),
      {name} AS (
        SELECT * FROM {name}_piece WHERE w <> 0 AND xa < xb
        UNION ALL
        SELECT {same}, cx, cy, cx * s, (cx + 1) * s, (cy + 1) * s, (cy + 1) * s, w
        FROM (SELECT * FROM {name}_above WHERE w <> 0 AND lower < ra) LATERAL VIEW explode(sequence(lower, ra - 1)) v AS cy)"""


PIECE = ["xa", "xb", "ya", "yb", "w"]


def winding_sql(pieces: str, x: str = "x", y: str = "y") -> str:
    """Winding number of a point from the array of its tile's pieces."""
    return f"""aggregate(filter({pieces}, p -> p.xa <= {x} AND {x} < p.xb
        AND p.ya + (p.yb - p.ya) * ({x} - p.xa) / (p.xb - p.xa) > {y}), 0, (n, p) -> n + p.w)"""


def polygon_tiles(polys: DataFrame, key: str, cell: float) -> DataFrame:
    """The pieces of polygons (``key``, rings) by tile, as ``polygon_ctes`` describes them."""
    from .spatial import with_bbox

    return polys.sparkSession.sql(f"WITH {polygon_ctes('t', '{polys}', [key], cell)} SELECT * FROM t", polys=with_bbox(polys))
