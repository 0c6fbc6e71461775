"""Ordering, spatial, tail and ingest operators against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from perilweave.operators import nearest as N
from perilweave.operators import ordering as O
from perilweave.operators import quality as Q
from perilweave.operators import spatial as S
from perilweave.operators import tail as T
from perilweave.schema import OUTPUT_COLUMNS, SCORED_COLUMNS, missing_columns, require_columns
from perilweave.sources.sinks import read_complete, write_complete


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(1)
    n = 3000
    v = np.where(rng.random(n) < 0.35, 0.0, rng.normal(size=n) * rng.choice([1e-6, 1, 1e6], n))
    return pd.DataFrame({"id": np.arange(n) * 1000, "v": v})


def test_rank_and_running_total_with_a_hot_value(spark, skewed):
    out = O.running(spark.createDataFrame(skewed), "v", "id", total_of="v").toPandas().sort_values("id")
    want = skewed.sort_values(["v", "id"])
    assert (out.set_index("id").rn.loc[want.id].to_numpy() == np.arange(1, len(want) + 1)).all()
    assert np.allclose(out.set_index("id").running_total.loc[want.id], want.v.cumsum(), atol=1e-5)


def test_quantiles_are_exact(spark, skewed):
    got = O.quantiles(spark.createDataFrame(skewed), {"a": ("v", 0.05), "b": ("v", 0.995), "c": ("id", 0.5)}).first()
    assert got.a == pytest.approx(np.percentile(skewed.v, 5))
    assert got.b == pytest.approx(np.percentile(skewed.v, 99.5))
    assert got.c == pytest.approx(np.percentile(skewed.id, 50))


@pytest.mark.parametrize("n", [23, 100, 912])
def test_decile_groups_match_quantile_cut(spark, skewed, n):
    d = skewed.head(n)
    got = O.decile_group(spark.createDataFrame(d), "v", "id").toPandas().set_index("id").group.loc[d.id]
    want = pd.qcut(d.v.rank(method="first"), 10, labels=False) + 1
    assert (got.to_numpy() == want.to_numpy()).all()


def polygons(spark, rows):
    return spark.createDataFrame(rows, "pid long, rings array<array<struct<x:double,y:double>>>")


SQUARE = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
HOLE = [(2.0, 2.0), (2.0, 8.0), (8.0, 8.0), (8.0, 2.0)]


def test_overlay_with_hole_and_many_edges(spark):
    t = np.linspace(0, 2 * np.pi, 401)[:-1]
    circle = [(5 + 4 * np.cos(a), 5 + 4 * np.sin(a)) for a in t]
    a = polygons(spark, [(1, [SQUARE, HOLE]), (2, [SQUARE])]).withColumnRenamed("pid", "a")
    b = polygons(spark, [(7, [[tuple(map(float, p)) for p in circle]])]).withColumnRenamed("pid", "b")
    got = {r.a: r.overlap for cell in (3.0,) for r in S.overlay_area(a, b, "a", "b", cell).collect()}
    full = 0.5 * 400 * 16 * np.sin(2 * np.pi / 400)
    assert got[2] == pytest.approx(full, rel=1e-9)
    # the hole keeps what lies outside the 6 x 6 square
    rng = np.random.default_rng(0)
    pts = rng.uniform(1, 9, (400_000, 2))
    inside = ((pts - 5) ** 2).sum(1) < 16
    ring = inside & ~((pts > 2).all(1) & (pts < 8).all(1))
    assert got[1] == pytest.approx(64 * ring.mean(), abs=0.15)
    for cell in (1.0, 50.0):
        other = {r.a: r.overlap for r in S.overlay_area(a, b, "a", "b", cell).collect()}
        assert other[1] == pytest.approx(got[1], abs=1e-9)


def test_points_respect_holes(spark):
    p = polygons(spark, [(1, [SQUARE, HOLE])])
    pts = spark.createDataFrame([(1, 5.0, 5.0), (2, 1.0, 5.0), (3, 11.0, 5.0)], "point_id long, x double, y double")
    assert [r.point_id for r in S.points_in_polygons(pts, p, "pid", 4.0).collect()] == [2]


def test_knn_against_brute_force_with_a_cluster(spark):
    rng = np.random.default_rng(4)
    far = rng.uniform(0, 1000, (300, 2))
    cluster = 500 + rng.normal(0, 1e-3, (400, 2))
    copies = np.full((100, 2), 777.0)
    pts = np.vstack([far, cluster, copies])
    p = spark.createDataFrame(pd.DataFrame({"point_id": np.arange(len(pts)), "x": pts[:, 0], "y": pts[:, 1]}))
    tg = rng.uniform(0, 1000, (60, 2))
    t = spark.createDataFrame(pd.DataFrame({"tid": np.arange(60), "x": tg[:, 0], "y": tg[:, 1]}))
    got = N.knn_join(t, p, "tid", "point_id", 4).toPandas().sort_values(["tid", "rank"])
    d = np.sqrt(((tg[:, None] - pts[None]) ** 2).sum(-1))
    want = np.sort(d, axis=1)[:, :4].ravel()
    assert np.allclose(got.distance, want)


def test_tail_from_positive_rows_equals_dense(spark):
    rng = np.random.default_rng(2)
    n, rows = 400, []
    dense = np.where(rng.random((5, n)) < 0.02, rng.lognormal(3, 1, (5, n)), 0.0)
    for i, j in zip(*np.nonzero(dense)):
        rows.append((int(i), int(j), float(dense[i, j])))
    y = spark.createDataFrame(rows, "district_id long, year_id long, loss double")
    d = spark.range(5).withColumnRenamed("id", "district_id")
    got = T.tail_measures(y, d, n).toPandas().sort_values("district_id")
    assert np.allclose(got.tvar99, np.sort(dense, axis=1)[:, -4:].mean(1))
    assert np.allclose(got.var995, np.quantile(dense, 0.995, axis=1))


def test_allocation_adds_up_and_ignores_partitioning(spark):
    y = spark.range(5000).selectExpr("id % 20 AS district_id", "id % 300 AS year_id", "CAST((id * 7919) % 1009 AS DOUBLE) AS loss")
    y = y.groupBy("district_id", "year_id").agg(F.sum("loss").alias("loss"))
    e = spark.range(20).selectExpr("id AS district_id", "CAST(1 + id % 3 AS DOUBLE) AS households")
    results = []
    for parts in (1, 7, 64):
        a = T.euler_allocation(y.repartition(parts), e, 300).join(e, "district_id").toPandas()
        results.append(a.sort_values("district_id").euler.to_numpy())
        tv = T.portfolio_tvar(y, e, 300).first()[0]
        assert (a.euler * a.households).sum() / a.households.sum() == pytest.approx(tv)
    assert (results[0] == results[1]).all() and (results[0] == results[2]).all()


def test_kendall_tau_against_pairs(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=301)
    y = 0.6 * x + rng.normal(size=301)
    got = T.kendall_tau(spark.createDataFrame(pd.DataFrame({"id": np.arange(301), "x": x, "y": y})), "x", "y", "id").first()
    s = np.sign(x[:, None] - x) * np.sign(y[:, None] - y)
    assert got.tau == pytest.approx(s.sum() / (301 * 300))


def test_bootstrap_interval_holds_the_estimate(spark):
    base = spark.range(4000).selectExpr("id % 40 AS district_id", "CAST(id / 40 AS BIGINT) AS year_id", "CAST(1 + (id * 7919) % 1009 AS DOUBLE) AS loss")
    other = base.withColumn("loss", F.col("loss") * 0.9)
    got = T.bootstrap_ci(base, other, 40_000, replicates=40).first()
    assert got.ci_low <= 100 * (1 / 0.9 - 1) + 1e-6 and got.ci_high >= 100 * (1 / 0.9 - 1) - 1e-6


def test_truncated_layers_never_pass(spark, tmp_path):
    df = spark.range(200)
    status = lambda want: Q.completeness_gate(df, want).first()["status"]
    assert status(600) == "incomplete" and status(None) == "incomplete" and status(200) == "complete"
    layer = str(tmp_path / "layer")
    assert not write_complete(df, layer, 600) and not write_complete(df, layer, None)
    assert read_complete(spark, layer, df.schema) is None
    assert write_complete(df, layer, 200) and read_complete(spark, layer, df.schema).count() == 200
    assert not write_complete(spark.range(150), layer, 200) and read_complete(spark, layer, df.schema).count() == 200


def test_contract(spark):
    df = spark.range(1).withColumnRenamed("id", "name")
    assert "area" in missing_columns(df, SCORED_COLUMNS) and "premium" not in SCORED_COLUMNS
    assert len(OUTPUT_COLUMNS) == len(set(OUTPUT_COLUMNS))
    with pytest.raises(ValueError, match="area"):
        require_columns(df, SCORED_COLUMNS, "scoring")


def test_gumbel_fit_of_equal_maxima_has_no_level(spark):
    from perilweave.operators import weather as W

    rows = [(p, 2000 + y, g) for p, g in ((1, 104.999), (2, 105.0)) for y in range(7)]
    rows += [(3, 2000 + y, 100 + y / 2) for y in range(7)] + [(4, 2000, 99.0)]
    maxima = spark.createDataFrame(rows, "point_id long, year int, gust double")
    got = {r.point_id: r.rp50 for r in W.gumbel_return_level(maxima, out="rp50").collect()}
    assert np.isnan(got[1]) and np.isnan(got[2]) and got[4] is None
    assert got[3] == pytest.approx(104.51449, abs=1e-5)


def two_runs(spark):
    base = spark.range(4000).selectExpr("id % 40 AS district_id", "CAST(id / 40 AS BIGINT) AS year_id", "CAST(1 + (id * 7919) % 1009 AS DOUBLE) AS loss")
    return base, base.withColumn("loss", F.col("loss") * 0.9)


def test_bootstrap_draws_each_weight_once_and_in_all_tasks(spark, monkeypatch):
    plans, write = {}, T.materialize
    monkeypatch.setattr(T, "materialize", lambda df, label: plans.update({label: df._jdf.queryExecution().toString()}) or write(df, label))
    T.bootstrap_ci(*two_runs(spark), 40_000, replicates=40)
    optimized = plans["blocks"].split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert optimized.count("md5(") == 1 and "RepartitionByExpression [run#" in optimized


def test_dependence_report_ranks_each_run_once(spark, monkeypatch):
    from perilweave.operators import ordering
    from perilweave.plans.rating import dependence_report

    written, write = [], ordering.materialize
    monkeypatch.setattr(ordering, "materialize", lambda df, label: written.append(label) or write(df, label))
    base, other = (y.withColumn("peril", F.lit("wx")) for y in two_runs(spark))
    got = dependence_report(base, other, 400, 100, 20).first()
    assert written.count("slices") == 3  # two runs and the interval
    assert got.tvar99_vine == pytest.approx(sum(sorted((1 + i * 7919 % 1009 for i in range(4000)), reverse=True)[:400]) / 400)
    assert got.tvar_uplift_pct == pytest.approx(100 * (1 / 0.9 - 1))


def test_far_targets_open_only_leaves_within_their_bound(spark):
    rng = np.random.default_rng(8)
    box = {f"{m}{a}": rng.uniform(0, 100, 400) for a in "xy" for m in ("min",)}
    leaves = pd.DataFrame({"slab": np.repeat(np.arange(20), 20), "leaf": np.tile(np.arange(20), 20), **box})
    leaves = leaves.assign(maxx=leaves.minx + 5, maxy=leaves.miny + 9)
    y = np.array([50.0, 500.0, 9000.0])
    circles = pd.DataFrame({"t": range(3), "p_minx": 40.0, "p_maxx": 40.0, "p_miny": y, "p_maxy": y, "r": [0.0, 410.0, 8905.0]})
    got = N._reached(spark.createDataFrame(circles), spark.createDataFrame(leaves)).select("t", "slab", "leaf").collect()
    want = set()
    for c in circles.itertuples():
        dx = np.maximum.reduce([leaves.minx - c.p_maxx, c.p_minx - leaves.maxx, 0 * leaves.minx])
        dy = np.maximum.reduce([leaves.miny - c.p_maxy, c.p_miny - leaves.maxy, 0 * leaves.miny])
        want |= {(c.t, r.slab, r.leaf) for r in leaves[np.hypot(dx, dy) <= c.r].itertuples()}
    assert len(got) == len(want) > 3 and {tuple(r) for r in got} == want


def test_weather_score_searches_once(spark):
    from perilweave.plans.scores import weather_score

    points = spark.range(300).selectExpr("id AS point_id", "id * 7919 % 101 AS x", "id * 104729 % 103 AS y", *[f"CAST(id % 17 AS DOUBLE) AS {c}" for c in ("wind", "wdr", "rain10", "precip", "gust_rp50")])
    targets = spark.range(50).selectExpr("id AS district_id", "id * 2 AS x", "id * 1000 AS y")
    out = weather_score(targets, [(points, ["wind", "wdr", "rain10", "precip", "gust_rp50"])])
    read = out.inputFiles()
    assert any("interpolated-" in f for f in read) and not any("leaves-" in f for f in read)
    assert out.count() == 50
