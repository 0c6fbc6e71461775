"""Files written from the tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import spatial as S
from ..session import shared_dir
from ..sources import readers as Rd
from ..sources import sinks as Sk
from .base import area_expr, load_input, query, sql
from .spatial import districts


def _scratch(spark):
    return f"{shared_dir(spark)}/perilweave/files-{uuid.uuid4().hex}"


@query("k3_a1_feature_files", sql("district_corners", f"""
    SELECT district_id, concat('A', CAST(s_nationkey AS VARCHAR)) AS area, round({area_expr()}, 1) AS size FROM district_corners JOIN supplier ON district_id = s_suppkey"""))
def features(spark, sf):
    """Write features, land them as one-line collections by area, and read the folders back."""
    root = _scratch(spark)
    s = load_input(spark, sf, "supplier").selectExpr("s_suppkey AS district_id", "concat('A', CAST(s_nationkey AS STRING)) AS area")
    Sk.write_feature_collection(districts(spark, sf), f"{root}/features", ["district_id"])
    lines = spark.read.text(f"{root}/features").withColumn(
        "district_id", F.get_json_object("value", "$.properties.district_id").cast("long")
    )
    lines.join(s, "district_id").select(
        "area", F.concat(F.lit('{"type": "FeatureCollection", "features": ['), "value", F.lit("]}")).alias("value")
    ).write.partitionBy("area").text(f"{root}/landed")
    back = Rd.read_features(spark, f"{root}/landed/*", {"district_id": "BIGINT"}, one_per_file=False)
    # Spark names its own files, so the area comes from the table here
    return back.drop("area").join(s, "district_id").select(
        "district_id", "area", F.round(S.ring_area(), 1).alias("size")
    )


@query("a3_a6_a13_keyed_csv", """SELECT n_nationkey, n_name, 0 AS from_absent FROM nation""")
def keyed(spark, sf):
    """Write a CSV whose first header has a byte-order mark; read it untyped, typed, and absent."""
    root = _scratch(spark)
    n = load_input(spark, sf, "nation").select("n_nationkey", "n_name")
    n.select(F.col("n_nationkey").alias("﻿n_nationkey"), "n_name").coalesce(1).write.option("header", True).csv(f"{root}/bom")
    n.write.option("header", True).csv(f"{root}/typed")
    loose = Rd.read_bom_csv(spark, f"{root}/bom").select(F.col("n_nationkey").cast("int"), "n_name")
    typed = Rd.read_keyed_csv(spark, f"{root}/typed", "n_nationkey INT, n_name STRING")
    absent = Rd.optional_input(spark, f"{root}/absent", "n_nationkey INT, extra INT")
    both = loose.intersect(typed).join(absent, "n_nationkey", "left")
    return both.select("n_nationkey", "n_name", F.coalesce("extra", F.lit(0)).alias("from_absent"))
