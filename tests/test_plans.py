"""Plans: inputs are read once, and no search meets everything with everything."""

import pytest
from pyspark.sql import functions as F

from perilweave.catalog import base, load
from perilweave.operators import nearest as N

SF = "/root/testdata/sf0.001"


# the bucket summary reads two year-loss tables, each derived from the line items once
@pytest.mark.parametrize("name, tables", [
    ("flagship_worst_years", 1), ("g22_tail_concentration", 1), ("g24_bucket_summary", 2), ("w1_decile_group", 1), ("t1_top_premium", 1),
])
def test_line_items_are_read_once(spark, monkeypatch, name, tables):
    reads, real = [], base.table
    monkeypatch.setattr(base, "table", lambda s, sf, t: reads.append(t) or real(s, sf, t))
    plan = load()[0][name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert reads.count("lineitem") == tables and "l_orderkey" not in plan


def test_nearest_search_has_no_product(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = spark.range(50).selectExpr("id", "CAST(id * 37 % 101 AS DOUBLE) AS x", "CAST(id * 53 % 97 AS DOUBLE) AS y")
        p = spark.range(2000).selectExpr("id AS p", "CAST(id * 7 % 89 AS DOUBLE) AS x", "CAST(id * 11 % 83 AS DOUBLE) AS y")
        near = N.knn_join(t, p, "id", "p", 3)
        plan = near._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
        got = {(r.id, r["rank"]): r.distance for r in near.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    points = [(r.x, r.y) for r in p.collect()]
    for r in t.collect():
        want = sorted(((r.x - x) ** 2 + (r.y - y) ** 2) ** 0.5 for x, y in points)[:3]
        assert [got[r.id, k + 1] for k in range(3)] == pytest.approx(want)


def test_targets_far_outside_find_their_neighbours(spark):
    t = spark.createDataFrame([(1, 1e6, -1e6), (2, 5.0, 5.0), (3, -3.0, 400.0)], "id long, x double, y double")
    p = spark.range(300).selectExpr("id AS p", "CAST(id % 17 AS DOUBLE) AS x", "CAST(id % 23 AS DOUBLE) AS y")
    got = {(r.id, r["rank"]): r.distance for r in N.knn_join(t, p, "id", "p", 4).collect()}
    points = [(r.x, r.y) for r in p.collect()]
    for i, x0, y0 in ((1, 1e6, -1e6), (2, 5.0, 5.0), (3, -3.0, 400.0)):
        want = sorted(((x0 - x) ** 2 + (y0 - y) ** 2) ** 0.5 for x, y in points)[:4]
        assert [got[i, k + 1] for k in range(4)] == pytest.approx(want)


def test_bedrock_overlay_runs_once_and_a_covered_map_needs_no_search(spark, monkeypatch):
    from perilweave.plans import scores as P

    # corners away from the lines on which the tiles of the layers meet
    box = lambda x, y, w: [[(x, y), (x + w, y), (x + w, y + w), (x, y + w)]]
    rings = "rings array<array<struct<x:double,y:double>>>"
    rock = spark.createDataFrame(
        [(7, "CLAY", "c", "p", 0.9, box(0.5, 0.5, 20.0)), (8, "CHALK", "c", "p", 0.1, box(20.5, 0.5, 20.0))],
        f"zone_id long, lex_d string, rcs_d string, max_period string, given double, {rings}",
    )
    inside = [(1, box(2.0, 2.0, 5.0)), (2, box(18.5, 3.0, 4.0))]
    scored = lambda rows: P.bedrock_score(
        spark.createDataFrame(rows, f"district_id long, {rings}"), rock, 30.0, susc=F.col("given")
    )
    far = scored([*inside, (3, box(90.0, 0.5, 5.0))])
    assert "lvs#" not in far._jdf.queryExecution().optimizedPlan().toString()
    got = {r.district_id: (round(r.bed_score, 9), r.geol) for r in far.collect()}
    assert got == {1: (0.9, "CLAY"), 2: (0.5, "CLAY"), 3: (0.1, "none (low-plasticity bedrock)")}

    def none_wanted(*_):
        raise AssertionError("the layer was dealt for no target")

    monkeypatch.setattr(N, "near", none_wanted)
    covered = scored(inside)
    assert {r.district_id: r.geol for r in covered.collect()} == {1: "CLAY", 2: "CLAY"}
    assert dict(covered.dtypes) == dict(far.dtypes)
