"""Restartable ingest and daily maxima as Structured Streaming jobs.

State lives in the tables that the micro-batches write, one folder a batch, so
nothing is forgotten and nothing is held for ever. A batch that is run again
writes its own folder anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.readers import read_if_present


def _batches(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table that micro-batches have written so far, with the number of each row's batch."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    whole = T.StructType([*fields.fields, T.StructField("batch", T.LongType())])
    return read_if_present(spark, path, whole)


def _run(stream: DataFrame, take, checkpoint: str) -> None:
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query.start().awaitTermination()


def ingest_pages_stream(spark: SparkSession, source: str, schema, key: str, staging: str, checkpoint: str) -> DataFrame:
    """Take in all landed page files once and return the staged table, each key once.

    The file source remembers finished files in ``checkpoint``, so a rerun
    after a failure takes up the rest. A batch is compared with what is staged,
    however long ago. Promotion is the completeness gate's business.
    """

    def take(pages: DataFrame, number: int) -> None:
        earlier = _batches(pages.sparkSession, staging, schema).where(F.col("batch") < number)
        fresh = pages.dropDuplicates([key]).join(earlier.select(key), key, "left_anti")
        fresh.select(*pages.columns).write.mode("overwrite").parquet(f"{staging}/batch={number}")

    _run(spark.readStream.schema(schema).parquet(source), take, checkpoint)
    return _batches(spark, staging, schema).drop("batch")


def daily_maxima(events: DataFrame, time: str, key: str, value: str) -> DataFrame:
    """Largest value per key and day, and the number of rows."""
    return (
        events.groupBy(F.date_trunc("day", F.col(time).cast("timestamp")).alias("day"), key)
        .agg(F.max(value).alias("peak"), F.count(F.lit(1)).alias("n"))
    )


def annual_maxima_stream(
    spark: SparkSession, source: str, schema, time: str, key: str, value: str, sink: str, checkpoint: str
) -> DataFrame:
    """Stream files into partial daily maxima and return the maxima over all partials.

    Every batch writes what it knows of its days; a day may have any number of
    partials, so a row counts however late it comes.
    """
    kind = f"day TIMESTAMP, `{key}` BIGINT, peak DOUBLE, n BIGINT"

    def take(events: DataFrame, number: int) -> None:
        daily_maxima(events, time, key, value).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    _run(spark.readStream.schema(schema).parquet(source), take, checkpoint)
    partials = _batches(spark, sink, kind)
    return partials.groupBy("day", key).agg(F.max("peak").alias("peak"), F.sum("n").alias("n"))
