"""Streams over two landings with a rerun and rows days late give the batch answer."""

from pyspark.sql import functions as F

from perilweave.streaming import ingest as I


def test_late_rows_count(spark, tmp_path):
    land, sink, mark = (str(tmp_path / x) for x in ("land", "daily", "mark"))
    rows = lambda *r: spark.createDataFrame(r, "ts string, k long, v double").withColumn("ts", F.col("ts").cast("timestamp"))
    first = rows(("2020-01-01 01:00", 1, 1.0), ("2020-01-20 01:00", 1, 2.0), ("2020-01-20 02:00", 2, 7.0))
    late = rows(("2020-01-01 05:00", 1, 99.0), ("2020-01-17 05:00", 1, 3.0))
    run = lambda: I.annual_maxima_stream(spark, land, first.schema, "ts", "k", "v", sink, mark)
    first.write.parquet(land)
    run()
    late.write.mode("append").parquet(land)
    got = {tuple(r) for r in run().collect()}
    want = {tuple(r) for r in I.daily_maxima(first.union(late), "ts", "k", "v").collect()}
    assert got == want == {tuple(r) for r in run().collect()}


def test_pages_are_taken_in_once(spark, tmp_path):
    land, staged, mark = (str(tmp_path / x) for x in ("land", "staged", "mark"))
    a = spark.range(10).select("id", (F.col("id") * 2).alias("v"))
    run = lambda: I.ingest_pages_stream(spark, land, a.schema, "id", staged, mark)
    a.union(a.where("id < 3")).write.parquet(land)
    assert run().count() == 10
    spark.range(5, 15).select("id", (F.col("id") * 2).alias("v")).write.mode("append").parquet(land)
    assert sorted(r.id for r in run().collect()) == list(range(15))
    assert run().count() == 15
