"""Writers of published results."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import completeness_gate
from .readers import read_if_present


def feature_rows(
    df: DataFrame, properties: list[str], rings: str = "rings", digits: int = 4, parts: str | None = None
) -> DataFrame:
    """One GeoJSON feature per row as text, coordinates rounded, rings closed.

    ``parts`` names a column of polygons, each an array of rings; such rows
    become MultiPolygon features, rows where it is NULL stay polygons.
    """
    pair = lambda p: F.array(F.round(p["x"], digits), F.round(p["y"], digits))

    def closed(r: Column) -> Column:
        points = F.transform(r, pair)
        first, last = F.element_at(points, 1), F.element_at(points, -1)
        return F.when((F.size(r) == 0) | (first == last), points).otherwise(F.concat(points, F.array(first)))

    def as_text(kind: str, coordinates: Column) -> Column:
        shape = F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))
        return F.to_json(
            F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), shape.alias("geometry"))
        )

    value = as_text("Polygon", F.transform(rings, closed))
    if parts:
        many = as_text("MultiPolygon", F.transform(parts, lambda p: F.transform(p, closed)))
        value = F.when(F.col(parts).isNotNull(), many).otherwise(value)
    return df.select(value.alias("value"))


def write_feature_collection(df: DataFrame, path: str, properties: list[str], rings: str = "rings") -> None:
    """Newline-delimited features, written in parallel."""
    feature_rows(df, properties, rings).write.text(path)


def write_table_csv(df: DataFrame, path: str) -> None:
    """Sorted export as CSV parts."""
    df.write.option("header", True).csv(path)


def year_summary_json(buckets: DataFrame, curve: DataFrame, worst: DataFrame) -> DataFrame:
    """One nested JSON document; each part has a fixed, small number of rows."""
    rows = lambda df: df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias("r")).scalar()
    doc: Column = F.struct(
        rows(buckets).alias("buckets"), rows(curve).alias("exceedance"), rows(worst).alias("worst_year")
    )
    return buckets.sparkSession.range(1).select(F.to_json(doc).alias("value"))


PROMOTED = "version STRING, found BIGINT, at TIMESTAMP"


def write_complete(df: DataFrame, path: str, expected: DataFrame | int | None) -> bool:
    """Write a new version of the table at ``path``; point to it only if the count is as expected.

    Versions stand beside each other and the pointer is one row more in a small
    table, so no store has to rename a folder and readers never see half a
    table. An incomplete or unverifiable version stays unread.
    """
    spark, version = df.sparkSession, uuid.uuid4().hex
    df.write.parquet(f"{path}/version={version}")
    status = completeness_gate(spark.read.schema(df.schema).parquet(f"{path}/version={version}"), expected).first()
    if status["status"] != "complete":
        return False
    pointer = spark.range(1).select(
        F.lit(version).alias("version"), F.lit(status["found"]).cast("long").alias("found"), F.current_timestamp().alias("at")
    )
    pointer.write.mode("append").parquet(f"{path}/promoted")
    return True


def read_complete(spark: SparkSession, path: str, schema) -> DataFrame | None:
    """The version promoted last, or None."""
    last = read_if_present(spark, f"{path}/promoted", PROMOTED).orderBy(F.desc("at"), "version").first()
    return last and spark.read.schema(schema).parquet(f"{path}/version={last['version']}")
