"""Readers for landed hazard files, with schemas and fallbacks made explicit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOM = "﻿"


def _features_schema(properties: Mapping[str, str]) -> str:
    fields = ", ".join(f"`{k}`: {v}" for k, v in properties.items())
    return (
        f"features ARRAY<STRUCT<properties: STRUCT<{fields}>, "
        "geometry: STRUCT<type: STRING, coordinates: STRING>>>"
    )


def read_features(
    spark: SparkSession, path: str, properties: Mapping[str, str], one_per_file: bool = True
) -> DataFrame:
    """Feature collections of a folder: the file stem becomes ``area``, rings become arrays.

    With one collection per file, files are the unit of parallelism; with one
    per line, large files split. Polygons and multipolygons are read; other
    shapes give no rings.
    """
    raw = (
        spark.read.schema(_features_schema(properties)).option("multiLine", one_per_file).json(path)
        .select(F.regexp_extract(F.col("_metadata.file_name"), r"([^/]+?)\.[^.]+$", 1).alias("area"), F.explode("features").alias("f"))
    )
    one = F.from_json("f.geometry.coordinates", "ARRAY<ARRAY<ARRAY<DOUBLE>>>")
    many = F.from_json("f.geometry.coordinates", "ARRAY<ARRAY<ARRAY<ARRAY<DOUBLE>>>>")
    rings = F.when(F.col("f.geometry.type") == "Polygon", one).when(
        F.col("f.geometry.type") == "MultiPolygon", F.flatten(many)
    )
    as_points = F.transform(
        rings, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    )
    return raw.select("area", *[F.col(f"f.properties.{k}").alias(k) for k in properties], as_points.alias("rings"))


def project_properties(df: DataFrame, column: str, keep: Mapping[str, str]) -> DataFrame:
    """Keep-list of properties of a JSON text column; absent ones are NULL."""
    schema = ", ".join(f"`{k}` {v}" for k, v in keep.items())
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.from_json(column, schema).alias("_p")).select(*rest, "_p.*")


def read_keyed_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Typed lookup table by header; a malformed row stops the job."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)


def read_bom_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV as text columns; a byte-order mark is taken off the first header."""
    df = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    return df.toDF(*[c.lstrip(BOM).strip() for c in df.columns])


def resolve_columns(df: DataFrame, wanted: Mapping[str, Sequence[str]]) -> DataFrame | None:
    """Select logical columns by the first alias present, ignoring case; None if one is missing."""
    by_name = {c.strip().lower(): c for c in reversed(df.columns)}
    picked = {}
    for logical, aliases in wanted.items():
        found = next((by_name[a.lower()] for a in aliases if a.lower() in by_name), None)
        if found is None:
            return None
        picked[logical] = found
    return df.select(*[F.col(f"`{c}`").alias(k) for k, c in picked.items()])


def find_name_column(df: DataFrame, prefix: str, suffix: str, probe: str) -> str:
    """Column named prefix..suffix, else the first text column whose values hold a word."""
    for c in df.columns:
        if c.upper().startswith(prefix) and c.upper().endswith(suffix):
            return c
    text = [c for c, t in df.dtypes if t == "string"]
    found = df.agg(*[F.max(F.upper(c).contains(probe.upper())).alias(c) for c in text]).first() if text else {}
    for c in text:
        if found[c]:
            return c
    raise ValueError(f"no name column among {df.columns}")


def union_pages(pages: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Landed pages as one table; a row that two pages repeat counts once."""
    return pages.dropDuplicates([key] if isinstance(key, str) else list(key))


def drop_incomplete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(how="any", subset=list(columns))


def _absent(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def read_if_present(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The parquet table at ``path``, or an empty one of the same shape if it is absent."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if not _absent(error):
            raise
        return spark.createDataFrame([], schema)


def optional_input(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The CSV table at ``path``, or an empty one of the same shape if it is absent."""
    try:
        return read_keyed_csv(spark, path, schema)
    except AnalysisException as error:
        if not _absent(error):
            raise
        return spark.createDataFrame([], schema)


def resume_by_partition(df: DataFrame, done: DataFrame, column: str, layout: DataFrame) -> DataFrame:
    """Rows of partitions not done yet; everything again if the layout has changed.

    ``done`` has (column, layout), one row per finished partition; ``layout``
    is one row with the fingerprint (such as the district count) of this run.
    """
    now = layout.scalar()
    finished = done.where(F.col("layout") == now).select(column).distinct()
    return df.join(finished, column, "left_anti")
