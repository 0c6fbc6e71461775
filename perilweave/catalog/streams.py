"""Streaming queries, run to the end of their input and compared with batch SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources.sinks import read_complete, write_complete
from ..streaming.ingest import annual_maxima_stream, ingest_pages_stream
from .base import load_input, query


def _scratch(spark):
    return f"{shared_dir(spark)}/perilweave/stream-{uuid.uuid4().hex}"


@query("x1_ingest_pages_stream", """SELECT o_custkey % 7 AS part, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""")
def pages(spark, sf):
    root = _scratch(spark)
    o = load_input(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    # landed pages overlap: every row is in two of them
    o.unionByName(o).repartition(8).write.parquet(f"{root}/landed")
    staged = ingest_pages_stream(spark, f"{root}/landed", o.schema, "o_orderkey", f"{root}/staged", f"{root}/checkpoint")
    write_complete(staged, f"{root}/orders", o.agg(F.count(F.lit(1)).alias("n")))
    done = read_complete(spark, f"{root}/orders", o.schema)
    return done.groupBy((F.col("o_custkey") % 7).alias("part")).agg(
        F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@query("x2_annual_maxima_stream", """WITH d AS (SELECT CAST(ts AS DATE) AS day, user_id, max(value) AS peak, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT user_id, CAST(year(day) AS INT) AS year, max(peak) AS peak, count(*) AS days, CAST(sum(n) AS BIGINT) AS n FROM d GROUP BY 1, 2""")
def maxima(spark, sf):
    root = _scratch(spark)
    e = load_input(spark, sf, "events")
    path = f"{root}/landed"
    e.select("ts", "user_id", "value").repartition(4).write.parquet(path)
    schema = spark.read.parquet(path).schema
    daily = annual_maxima_stream(spark, path, schema, "ts", "user_id", "value", f"{root}/daily", f"{root}/checkpoint")
    return daily.groupBy("user_id", F.year("day").alias("year")).agg(
        F.max("peak").alias("peak"), F.count("*").alias("days"), F.sum("n").alias("n")
    )
