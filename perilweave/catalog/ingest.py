"""Ingest checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from ..sources import readers as Rd
from .base import load_input, query


@query("a2_project_properties", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST(NULL AS VARCHAR) AS absent FROM events""")
def properties(spark, sf):
    e = load_input(spark, sf, "events").select("event_id", "props")
    return Rd.project_properties(e, "props", {"k": "INT", "absent": "STRING"})


@query("a4_resolve_columns", """SELECT o_orderkey AS pcds, o_custkey AS area FROM orders""")
def resolve(spark, sf):
    o = load_input(spark, sf, "orders").toDF("PCD7", "LSOA11CD", "status", "price", "date", "priority")
    return Rd.resolve_columns(o, {"pcds": ["pcds", "pcd7", "pcd"], "area": ["lsoa21cd", "lsoa11cd"]}).select("pcds", "area")


@query("a5_find_name_column", """SELECT 'r_name' AS found, count(*) AS n FROM region WHERE upper(r_name) LIKE '%EUROPE%'""")
def name_column(spark, sf):
    r = load_input(spark, sf, "region")
    found = Rd.find_name_column(r, "CTRY", "NM", "europe")
    return r.where(F.upper(found).contains("EUROPE")).agg(F.lit(found).alias("found"), F.count("*").alias("n"))


@query("a7_union_pages", """SELECT o_orderkey, o_custkey FROM orders""")
def pages(spark, sf):
    o = load_input(spark, sf, "orders").select("o_orderkey", "o_custkey", F.floor(F.col("o_orderkey") / 1000).alias("page"))
    # every page repeats the rows of the next one
    overlapping = o.unionByName(o.withColumn("page", F.col("page") - 1))
    return Rd.union_pages(overlapping, "o_orderkey").select("o_orderkey", "o_custkey")


@query("a8_drop_incomplete_rows", """SELECT d.doc_id, quality, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NOT NULL AND toxic IS NOT NULL""")
def incomplete(spark, sf):
    d = load_input(spark, sf, "documents").select("doc_id").join(load_input(spark, sf, "labels"), "doc_id", "left")
    return Rd.drop_incomplete_rows(d, ["quality", "toxic"])


@query("a9_completeness_gate", """SELECT 'orders' AS layer, count(*) AS found, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS expected,
      CASE WHEN count(*) = (SELECT count(DISTINCT l_orderkey) FROM lineitem) THEN 'complete' ELSE 'incomplete' END AS status FROM orders
    UNION ALL SELECT 'labels', count(*), NULL, 'incomplete' FROM labels UNION ALL SELECT 'documents', count(*), count(DISTINCT doc_id), 'complete' FROM documents""")
def gate(spark, sf):
    t = lambda n: load_input(spark, sf, n)
    lines = t("lineitem").agg(F.count_distinct("l_orderkey").alias("n"))
    ids = t("documents").agg(F.count_distinct("doc_id").alias("n"))
    one = lambda n, want: Q.completeness_gate(t(n), want).select(F.lit(n).alias("layer"), "*")
    return one("orders", lines).unionByName(one("labels", None)).unionByName(one("documents", ids))


@query("a10_verify_layers", """WITH f AS (SELECT p_type AS layer, count(*) AS found FROM part GROUP BY 1),
    e AS (SELECT p_type AS layer, count(DISTINCT p_partkey) AS expected FROM part GROUP BY 1 UNION ALL SELECT 'ABSENT', 5)
    SELECT e.layer, coalesce(found, 0) AS found, expected, coalesce(found = expected, FALSE) AS ok FROM e LEFT JOIN f ON e.layer = f.layer""")
def verify(spark, sf):
    p = load_input(spark, sf, "part").withColumnRenamed("p_type", "layer")
    want = p.groupBy("layer").agg(F.count_distinct("p_partkey").alias("expected"))
    absent = spark.sql("SELECT 'ABSENT' AS layer, 5L AS expected")
    return Q.verify_layers(p, "layer", want.unionByName(absent))


@query("a11_incremental_todo", """WITH g AS (SELECT vec_id AS point_id, 1000 * CAST(embedding[1] AS DOUBLE) AS x, 1000 * CAST(embedding[2] AS DOUBLE) AS y, label FROM embeddings),
    t AS (SELECT point_id, row_number() OVER (ORDER BY point_id) AS rn FROM g WHERE (round(x, 0), round(y, 0)) NOT IN (SELECT (round(x, 0), round(y, 0)) FROM g WHERE label = 1))
    SELECT point_id FROM t WHERE (rn - 1) % 2 = 0""")
def todo(spark, sf):
    g = load_input(spark, sf, "embeddings").selectExpr(
        "vec_id AS point_id", "1000 * CAST(embedding[0] AS DOUBLE) AS x", "1000 * CAST(embedding[1] AS DOUBLE) AS y", "label"
    )
    return Q.incremental_todo(g, g.where("label = 1"), ["x", "y"]).select("point_id")


@query("a12_resume_by_partition", """SELECT l_suppkey AS tile_id, count(*) AS pixels FROM lineitem
    WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) GROUP BY 1""")
def resume(spark, sf):
    px = load_input(spark, sf, "lineitem").select(F.col("l_suppkey").alias("tile_id"))
    s = load_input(spark, sf, "supplier")
    layout = s.agg(F.count("*").alias("n"))
    done = s.where("s_acctbal > 5000").select(F.col("s_suppkey").alias("tile_id"), layout.scalar().alias("layout"))
    stale = s.select(F.col("s_suppkey").alias("tile_id"), F.lit(-1).cast("long").alias("layout"))
    left = Rd.resume_by_partition(px, done.unionByName(stale), "tile_id", layout)
    return left.groupBy("tile_id").agg(F.count("*").alias("pixels"))


@query("a14_no_nan_gate", """SELECT count(*) AS rows, CAST(sum(CAST(isnan(CAST(l_quantity AS DOUBLE)) AS INT)
      + CAST(isnan(CAST(l_extendedprice AS DOUBLE)) AS INT) + CAST(isnan(CAST(l_discount AS DOUBLE)) AS INT)
      + CAST(isnan(CAST(l_tax AS DOUBLE)) AS INT)) AS BIGINT) AS nan_values FROM lineitem""")
def nan_gate(spark, sf):
    return Q.no_nan_gate(load_input(spark, sf, "lineitem"))
