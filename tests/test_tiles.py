"""Polygon joins on tiles: exact areas and points, spread of large polygons, slivers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from perilweave.operators import spatial as S
from perilweave.operators.tiles import BOX, box_ctes, met_ctes, polygon_tiles


def polygons(spark, shapes, key):
    rows = [(i, [[(float(x), float(y)) for x, y in p]]) for i, p in enumerate(shapes)]
    return spark.createDataFrame(rows, f"{key} long, rings array<array<struct<x:double,y:double>>>")


def clipped(subject, convex):
    """Corners of ``subject`` inside a convex counter-clockwise polygon, side after side."""
    out = subject
    for (x1, y1), (x2, y2) in zip(convex, convex[1:] + convex[:1]):
        given, out = out, []
        for p, q in zip(given, given[1:] + given[:1]):
            a, b = ((x2 - x1) * (r[1] - y1) - (y2 - y1) * (r[0] - x1) for r in (p, q))
            if a >= 0:
                out.append(p)
            if (a >= 0) != (b >= 0):
                t = a / (a - b)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
    return out


def area(p):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1])) / 2


def star(rnd, x, y, r, n):
    return [(x + r * rnd.uniform(0.3, 1) * math.cos(t), y + r * rnd.uniform(0.3, 1) * math.sin(t)) for t in sorted(rnd.uniform(0, 2 * math.pi) for _ in range(n))]


def regular(x, y, r, n):
    return [(x + r * math.cos(2 * math.pi * i / n), y + r * math.sin(2 * math.pi * i / n)) for i in range(n)]


def on_borders(rnd):
    x, y, w, h = rnd.randrange(-8, 8) * 2, rnd.randrange(-8, 8) * 2, rnd.choice([1, 2, 4, 8]), rnd.choice([1, 2, 4, 8])
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


@pytest.fixture(scope="module")
def layers():
    rnd = random.Random(5)
    spot = lambda: (rnd.uniform(-20, 20), rnd.uniform(-20, 20))
    a = [star(rnd, *spot(), rnd.choice([0.3, 3, 15]), rnd.choice([5, 9, 60, 400])) for _ in range(25)]
    b = [regular(*spot(), rnd.choice([0.05, 1, 8, 40]), rnd.choice([3, 4, 7, 50])) for _ in range(40)]
    return a + [on_borders(rnd) for _ in range(15)], b + [on_borders(rnd) for _ in range(15)]


@pytest.mark.parametrize("cell", [1.0, 0.37, 64.0])
def test_areas_equal_clipping_at_any_cell(spark, layers, cell):
    a, b = layers
    found = S.overlay_area(polygons(spark, a, "a"), polygons(spark, b, "b"), "a", "b", cell)
    got = {(r.a, r.b): r.overlap for r in found.collect()}
    want = {(i, j): area(clipped(p, q)) for i, p in enumerate(a) for j, q in enumerate(b)}
    want = {k: v for k, v in want.items() if v > 1e-9}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(v, rel=1e-7, abs=1e-9) for k, v in want.items())


@pytest.mark.parametrize("cell", [1.0, 0.37, 64.0])
def test_points_equal_counting_all_edges(spark, layers, cell):
    shapes, rnd = layers[0], random.Random(int(cell))
    points = [(n, rnd.uniform(-25, 25), rnd.uniform(-25, 25)) for n in range(800)]
    points += [(1000 + n, float(rnd.randrange(-10, 10)), float(rnd.randrange(-10, 10))) for n in range(200)]
    found = S.points_in_polygons(spark.createDataFrame(points, "n long, x double, y double"), polygons(spark, shapes, "a"), "a", cell)
    want = set()
    for n, x, y in points:
        for i, p in enumerate(shapes):
            above = sum(
                min(x1, x2) <= x < max(x1, x2) and y1 + (y2 - y1) * (x - x1) / (x2 - x1) > y
                for (x1, y1), (x2, y2) in zip(p, p[1:] + p[:1])
            )
            if above % 2:
                want.add((n, i))
    assert {(r.n, r.a) for r in found.collect()} == want


def test_slivers_stay_and_touching_polygons_do_not(spark):
    box = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    a = polygons(spark, [box(0, 0, 10, 10), box(500_000.3, 180_000.7, 1000, 1000)], "a")
    b = polygons(spark, [box(10 - 1e-9, 0, 10, 10), box(10, 0, 10, 10), box(501_000.3, 180_000.7, 700, 1000)], "b")
    got = {(r.a, r.b): r.overlap for r in S.overlay_area(a, b, "a", "b", 30.0).collect()}
    assert got.keys() == {(0, 0)} and got[0, 0] == pytest.approx(1e-8, rel=1e-6)


def test_a_national_box_on_a_fine_grid_has_few_tiles(spark):
    nation = polygons(spark, [[(-3, -3), (1_000_000, 0), (1_000_000, 1_300_000), (0, 1_300_000)]], "a")
    assert polygon_tiles(nation, "a", 30.0).count() < 40
    small = polygons(spark, [[(i * 997.0, i * 13.0), (i * 997.0 + 20, i * 13.0), (i * 997.0, i * 13.0 + 20)] for i in range(1, 900)], "b")
    found = S.overlay_area(nation, small, "a", "b", 30.0).collect()
    assert len(found) == 899 and all(r.overlap == pytest.approx(200) for r in found)


def test_a_polygon_of_many_edges_is_spread_over_tiles(spark):
    rnd = random.Random(2)
    turns = [2 * math.pi * i / 6_000 for i in range(6_000)]
    coast = [((900 + 40 * rnd.random()) * math.cos(t), (900 + 40 * rnd.random()) * math.sin(t)) for t in turns]
    pieces = polygon_tiles(polygons(spark, [coast], "a"), "a", 1.0)
    by_tile = pieces.groupBy("lv", "cx", "cy").count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
    assert by_tile["all"] < 400_000 and by_tile.most < by_tile["all"] / 40
    small = [[(x, y), (x + 9, y), (x + 9, y + 9), (x, y + 9)] for x in range(-950, 950, 120) for y in range(-950, 950, 120)]
    got = S.overlay_area(polygons(spark, [coast], "a"), polygons(spark, small, "b"), "a", "b", 1.0).collect()
    want = {j: v for j, q in enumerate(small) if (v := area(clipped(coast, q))) > 1e-9}
    assert {r.b for r in got} == want.keys()
    assert all(r.overlap == pytest.approx(want[r.b], rel=1e-7, abs=1e-7) for r in got)


def test_no_join_has_a_polygon_alone_as_its_key(spark, layers, capsys):
    a, b = polygons(spark, layers[0], "a"), polygons(spark, layers[1], "b")
    S.overlay_area(a, b, "a", "b", 1.0).explain()
    plan = capsys.readouterr().out
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and all("_tx" in line or "tx#" in line for line in joins)
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty_layers_meet_nothing(spark, layers):
    a, none = polygons(spark, layers[0], "a"), polygons(spark, [], "b")
    assert S.overlay_area(a, none, "a", "b", 1.0).isEmpty()
    points = spark.createDataFrame([(1, 0.0, 0.0)], "n long, x double, y double")
    assert S.points_in_polygons(points, none, "b", 1.0).isEmpty()


def test_polygons_of_one_file_are_cut_by_all_tasks(spark, layers, monkeypatch):
    cut = []
    boxes = S.with_bbox
    monkeypatch.setattr(S, "with_bbox", lambda df, rings="rings": cut.append(df) or boxes(df, rings))
    a, b = (polygons(spark, side, key).coalesce(1) for side, key in zip(layers, "ab"))
    S.overlay_area(a, b, "a", "b", 1.0)
    assert len(cut) == 2 and all(df.select(F.spark_partition_id()).distinct().count() > 4 for df in cut)


def test_rows_that_no_level_looks_up_are_not_placed(spark):
    boxes = lambda key, n, step, w: spark.range(n * n).selectExpr(
        f"id AS {key}", f"id % {n} * {step} AS minx", f"floor(id / {n}) * {step} AS miny", f"id % {n} * {step} + {w} AS maxx", f"floor(id / {n}) * {step} + {w} AS maxy"
    )
    count = lambda wanted, small_first: spark.sql(
        f"""WITH {box_ctes("ta", "{a}", ["a", *BOX], 1.0)}, {box_ctes("tb", "{b}", ["b", *BOX], 1.0)},
          {met_ctes("met", "ta", "tb", ["a", *BOX], ["b", *BOX], "a_minx < b_maxx AND b_minx < a_maxx AND a_miny < b_maxy AND b_miny < a_maxy")}
        SELECT {wanted}""",
        a=boxes("a", 20, "1.7D", "0.4D") if small_first else boxes("a", 6, "6.1D", "5.3D"),
        b=boxes("b", 6, "6.1D", "5.3D") if small_first else boxes("b", 20, "1.7D", "0.4D"),
    ).first()[0]
    along = sum(x * 1.7 < y * 6.1 + 5.3 and y * 6.1 < x * 1.7 + 0.4 for x in range(20) for y in range(6))
    for small_first in (True, False):
        assert count("count(DISTINCT a_a, b_b) FROM met", small_first) == along * along
        own = "(SELECT count(*) FROM met_a WHERE NOT finer) + (SELECT count(*) FROM met_b WHERE finer)"
        assert count(own, small_first) == count(f"count(*) FROM t{'b' if small_first else 'a'}", small_first)
