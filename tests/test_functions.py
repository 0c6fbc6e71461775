"""Property tests of the distribution and copula functions."""

import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from perilweave.functions import copula as C
from perilweave.functions import rules as R
from perilweave.functions.normal import with_norm_cdf, with_norm_ppf


def test_normal_matches_standard_library(spark):
    nd = statistics.NormalDist()
    p = [10.0**-k for k in range(1, 13)] + [0.5, 0.075, 0.9, 0.999, 1 - 1e-9]
    df = with_norm_ppf(spark.createDataFrame([(x,) for x in p], "p double"), {"z": "p"})
    out = with_norm_cdf(df, {"back": "z"}).toPandas()
    assert max(abs(z - nd.inv_cdf(x)) for z, x in zip(out.z, out.p)) < 1e-12
    assert max(abs(b - nd.cdf(z)) for b, z in zip(out.back, out.z)) < 1e-14


def test_null_stays_null(spark):
    df = spark.createDataFrame([(None,), (0.5,)], "p double")
    rows = {r.p: r for r in with_norm_cdf(with_norm_ppf(df, {"z": "p"}), {"c": "z"}).collect()}
    assert rows[None].z is None and rows[None].c is None and rows[0.5].c == pytest.approx(0.5)


@pytest.mark.parametrize("theta", [1.05, 1.5, 2.0, 3.0])
def test_h_inverse_round_trip(spark, theta):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"u": rng.uniform(0.02, 0.98, 4000), "v": rng.uniform(0.02, 0.98, 4000), "theta": theta})
    df = spark.createDataFrame(pdf).withColumns(
        {"t": C.gumbel_h(F.col("v"), F.col("u"), F.col("theta")), "x": -F.log("u")}
    )
    out = C.with_gumbel_h_inverse(df, "x", {"w": ("t", "theta")}).toPandas()
    assert (out.v - out.w).abs().max() < 1e-8


def test_h_is_a_distribution_and_has_the_independence_limit(spark):
    df = spark.range(1, 500).select((F.col("id") / 500).alias("v"))
    h = df.select("v", C.gumbel_h(F.col("v"), F.lit(0.4), F.lit(2.0)).alias("h")).orderBy("v").toPandas().h
    assert h.between(0, 1).all() and (h.diff().dropna() >= -1e-12).all()
    lim = df.select(F.abs(C.gumbel_h(F.col("v"), F.lit(0.63), F.lit(1 + 1e-9)) - F.col("v")).alias("d"))
    assert lim.agg(F.max("d")).first()[0] < 1e-5


def test_mixed_quantile_frequency_and_mean(spark):
    n = 200_000
    df = spark.range(n).select(
        ((F.col("id") + 0.5) / n).alias("u"), F.lit(0.05).alias("p"), F.log(F.lit(1e4)).alias("mu"), F.lit(0.9).alias("sigma")
    )
    out = C.with_mixed_quantile(df, {"loss": ("u", "p", "mu", "sigma")}).agg(
        F.avg((F.col("loss") > 0).cast("int")).alias("f"), F.avg("loss").alias("m")
    ).first()
    assert abs(out.f - 0.05) < 0.002
    assert abs(out.m / (0.05 * 1e4 * np.exp(0.405)) - 1) < 0.05


def test_blend_is_bounded_and_two_sided(spark):
    rows = list(zip([1.0, 1.0, 0.08, 0.08, 0.5, 0.9], [0.05, 0.05, 0.75, 0.75, 0.5, 0.45], [1.0, 0.0, 1.0, 0.0, 1.0, 0.5]))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, bed double, mod double, cover double")
    out = [r.s for r in df.select("i", R.blend_bounded(F.col("bed"), F.col("mod"), F.col("cover")).alias("s")).orderBy("i").collect()]
    assert out[1] == 1.0 and out[3] == 0.08
    assert out[0] == pytest.approx(0.525) and out[4] == pytest.approx(0.5)
    assert out[2] > 0.08


def test_coverage_mask(spark):
    rows = [("LEEDS", "England", 1.0), ("CARDIFF", "Wales", 1.0), ("DUNDEE", "Scotland", 1.0),
            ("BERWICK", "England", 0.64), ("CHESTER", "England", 0.97), ("UNKNOWN", None, None)]
    df = spark.createDataFrame(rows, "name string, country string, share double")
    got = {r.name_: r.m for r in df.select(F.col("name").alias("name_"), R.coverage_mask(F.col("country"), F.col("share")).alias("m")).collect()}
    assert got == {"LEEDS": True, "CARDIFF": False, "DUNDEE": False, "BERWICK": False, "CHESTER": True, "UNKNOWN": False}


def test_unknown_term_fails_the_job(spark):
    ok = spark.createDataFrame([(" till ",), ("PEAT",), ("",)], "t string")
    assert [r.susc for r in R.classify_closed(ok, "t").collect()] == [0.45]
    with pytest.raises(Exception, match="unclassified"):
        R.classify_closed(spark.createDataFrame([("MOON ROCK",)], "t string"), "t").collect()


def test_keyword_rules(spark):
    rows = [("London Clay Formation", None, None), ("x", "MUDSTONE", "Jurassic "), ("x", "MUDSTONE", "Silurian"), ("x", "CHALK", None)]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    got = [r.s for r in df.select(R.classify_keywords(F.col("a"), F.col("b"), F.col("c")).alias("s")).collect()]
    assert got == [pytest.approx(v) for v in (1.0, 0.4, 0.12, 0.08)]
