"""Readers on small files of their own."""

import json

import pytest
from pyspark.sql import functions as F

from perilweave.operators.spatial import ring_area
from perilweave.sources import readers as R
from perilweave.sources.sinks import feature_rows


def test_feature_files(spark, tmp_path):
    square = [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]]
    hole = [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [1, 2], [2, 2], [2, 1], [1, 1]]]
    doc = lambda *fs: json.dumps({"type": "FeatureCollection", "features": list(fs)}, indent=1)
    f = lambda name, kind, c: {"type": "Feature", "properties": {"name": name, "x": 1}, "geometry": {"type": kind, "coordinates": c}}
    (tmp_path / "AB.geojson").write_text(doc(f("AB1", "Polygon", square), f("AB2", "MultiPolygon", [hole, square])))
    (tmp_path / "CD.geojson").write_text(doc(f("CD1", "Polygon", hole)))
    got = R.read_features(spark, str(tmp_path), {"name": "STRING", "absent": "STRING"})
    rows = {r.name_: (r.area, r.size, r.absent) for r in got.select(F.col("name").alias("name_"), "area", "absent", ring_area().alias("size")).collect()}
    assert rows == {"AB1": ("AB", 16.0, None), "AB2": ("AB", 31.0, None), "CD1": ("CD", 15.0, None)}
    line = json.loads(feature_rows(got.where("name = 'CD1'"), ["name"]).first().value)
    assert line["properties"] == {"name": "CD1"} and len(line["geometry"]["coordinates"]) == 2
    open_ring = got.where("name = 'CD1'").withColumn("rings", F.transform("rings", lambda r: F.slice(r, 1, 4)))
    line = json.loads(feature_rows(open_ring.withColumn("parts", F.array("rings")), ["name"], parts="parts").first().value)
    assert line["geometry"]["type"] == "MultiPolygon"
    assert [r[0] == r[-1] and len(r) == 5 for r in line["geometry"]["coordinates"][0]] == [True, True]


def test_csv_readers(spark, tmp_path):
    (tmp_path / "bom.csv").write_bytes("﻿Postcode,GWTR_RISK\nM1 1AA,Possible\n".encode())
    assert R.read_bom_csv(spark, str(tmp_path / "bom.csv")).columns == ["Postcode", "GWTR_RISK"]
    (tmp_path / "ok.csv").write_text("name,v\nA,1.5\n")
    assert R.read_keyed_csv(spark, str(tmp_path / "ok.csv"), "name STRING, v DOUBLE").first().v == 1.5
    (tmp_path / "bad.csv").write_text("name,v\nA,oops\n")
    with pytest.raises(Exception):
        R.read_keyed_csv(spark, str(tmp_path / "bad.csv"), "name STRING, v DOUBLE").collect()
    assert R.optional_input(spark, str(tmp_path / "none.csv"), "name STRING, v DOUBLE").count() == 0


def test_column_resolution(spark):
    df = spark.createDataFrame([("M1 1AA", "E01", "England")], "PCD7 string, lsoa11cd string, ctry string")
    assert R.resolve_columns(df, {"pc": ["pcds", "pcd7"], "area": ["lsoa21cd", "LSOA11CD"]}).columns == ["pc", "area"]
    assert R.resolve_columns(df, {"pc": ["nothing"]}) is None
    assert R.find_name_column(df, "CTRY", "NM", "england") == "ctry"
    with pytest.raises(ValueError):
        R.find_name_column(df, "CTRY", "NM", "wales")
