"""Scores, calibration, simulation and pricing."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from perilweave.operators import tail as T
from perilweave.plans import assumptions as A
from perilweave.plans import marginals as M
from perilweave.plans import scores as Sc
from perilweave.plans.calibrate import calibrate_loading, frequency_multipliers, tail_frequency, weighted_mean


def fields(n=1, **over):
    base = dict(sub_score=0.5, wx_score=0.5, fl_score=0.3, gw_score=0.2, er_score=0.0, f_high=0.1, f_low=0.2,
                sw_high=0.1, sw_low=0.2, gw_frac=0.1, sw_sev=1.0, er_frac=0.0, er_nfi105=0.0, households=1000.0)
    base.update(over)
    return pd.DataFrame({"district_id": np.arange(n), **base})


def random_fields(n, seed=3):
    r = np.random.default_rng(seed)
    u = r.uniform
    return fields(n, sub_score=u(0.05, 1, n), wx_score=u(0.05, 1, n), fl_score=u(0, 1, n), gw_score=u(0, 1, n), er_score=u(0, 0.5, n),
                  f_high=u(0, 0.2, n), f_low=u(0.2, 0.5, n), sw_high=u(0, 0.1, n), sw_low=u(0.1, 0.3, n), gw_frac=u(0, 0.3, n),
                  sw_sev=u(0.8, 1.3, n), er_frac=u(0, 0.05, n), households=u(500, 40000, n))


def test_severity_means_hit_published_values(spark):
    df = M.marginal_severity(M.marginal_frequency(spark.createDataFrame(fields())))
    r = df.select(*[F.exp(F.col(f"mu_{k}") + F.col(f"sigma_{k}") ** 2 / 2).alias(k) for k in ("sub", "wx", "gw", "er")]).first()
    for k in ("sub", "wx", "gw", "er"):
        assert r[k] == pytest.approx(A.SEVERITY[k], rel=1e-6)


def test_erosion_frequency_is_the_share_over_the_horizon(spark):
    df = spark.createDataFrame(fields(er_frac=0.24))
    r = M.marginal_frequency(df, {k: 3.0 for k in A.INSURED}).first()
    assert r.p_er == pytest.approx(0.24 / 80, abs=1e-12)
    assert M.marginal_severity(M.marginal_frequency(df)).select(M.analytic_expected_loss("er").alias("e")).first().e == pytest.approx(0.003 * 250000)


def test_depth_raises_only_surface_water(spark):
    mu = lambda **kw: M.marginal_severity(M.marginal_frequency(spark.createDataFrame(fields(**kw)))).first().mu_fl
    assert mu(sw_sev=1.8) > mu(sw_sev=0.6)
    assert mu(sw_sev=1.8, sw_high=0.0, sw_low=0.0) == pytest.approx(mu(sw_sev=0.6, sw_high=0.0, sw_low=0.0), abs=1e-12)


DEPTH_COLS = "district_id long, " + ", ".join(f"{k}_{b} double" for k in Sc.DEPTH_KEYS for b in ("high", "low"))


def depth_rows(spark, rows):
    return spark.createDataFrame([(i, *[v for low in lows for v in (0.0, low)]) for i, lows in rows], DEPTH_COLS)


def test_depth_severity_fixture(spark):
    d = spark.createDataFrame(
        [(0, 0.05, 0.10, 1000.0, True), (1, 0.05, 0.10, 1000.0, True), (2, 0.0, 0.0, 1000.0, True), (3, 0.05, 0.10, 1000.0, False)],
        "district_id long, sw_high double, sw_low double, households double, covered boolean",
    )
    bands = depth_rows(spark, [(0, (0.05, 0.01, 0.001, 0.0, 0.0)), (1, (0.09, 0.08, 0.07, 0.05, 0.03)), (2, (0.0,) * 5), (3, (0.00002, 0.0, 0.0, 0.0, 0.0))])
    r = {x.district_id: x for x in Sc.depth_severity(d, bands).collect()}
    assert r[1].sw_sev > r[0].sw_sev and r[1].sw_depth_m > r[0].sw_depth_m
    assert r[2].sw_sev == 1.0 and r[2].sw_depth_m is None
    assert r[3].sw_sev == 1.0 and r[3].sw_depth_m is None
    assert (r[0].sw_sev + r[1].sw_sev) / 2 == pytest.approx(1.0, abs=1e-9)
    flat = Sc.depth_severity(d, None).collect()
    assert all(x.sw_sev == 1.0 and x.sw_depth_m is None for x in flat)
    deeper = Sc.depth_severity(d, bands.withColumns({c: F.least(F.col(c) * 1.5, F.lit(0.1)) for c in ("d06_low", "d09_low", "d12_low")}), reference=Sc.depth_reference(d, bands))
    assert deeper.where("district_id < 2").agg(F.avg("sw_sev")).first()[0] > 1.0


def test_calibration_hits_targets(spark):
    s = spark.createDataFrame(random_fields(60))
    mult = frequency_multipliers(s).first().asDict()
    rated = M.marginal_frequency(s, mult)
    got = rated.agg(*[weighted_mean(f"p_{k}", "households").alias(k) for k in A.INSURED]).first()
    for k in A.INSURED:
        assert got[k] == pytest.approx(A.TARGET_FREQUENCY[k], rel=1e-9)
    factor = calibrate_loading(rated)
    r = tail_frequency(rated, [factor]).first()
    assert r.tail / r.mean == pytest.approx(2.0, rel=1e-6)


def test_gaussian_factor_exists_over_the_whole_range(spark):
    g = spark.range(12).selectExpr("1 + id * 2D / 11 AS t")
    g = g.select(F.col("t").alias("theta_sub")).crossJoin(g.select(F.col("t").alias("theta_fl"))).crossJoin(
        g.select(F.col("t").alias("theta_gw"))
    ).withColumn("theta_er", F.col("theta_sub"))
    f = M.implied_factor(g.where("theta_fl < 3 AND theta_sub < 3 AND theta_gw < 3"))
    assert f.where(F.isnan("c_44") | F.col("c_44").isNull() | F.isnan("c_33")).count() == 0
