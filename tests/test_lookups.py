"""Lookup queries against their SQL where means meet a threshold, each other or a half."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry_module


@pytest.mark.parametrize("name", ["j13_override_where_covered", "j14_max_merge"])
def test_means_on_the_edge_equal_their_sql(spark, tmp_path, name):
    n = 400
    # Open lines average exactly 0.05, the threshold; closed ones the same from other values, or a half of the last digit.
    spark.range(n * 96).selectExpr(
        f"id % {n} AS l_suppkey", f"CAST(id / {n} AS INT) AS i"
    ).selectExpr(
        "l_suppkey", "CASE WHEN i < 80 THEN 'F' ELSE 'O' END AS l_linestatus",
        "CASE WHEN i >= 80 THEN CASE i % 2 WHEN 0 THEN 0.01 + (l_suppkey % 5) / 100D ELSE 0.09 - (l_suppkey % 5) / 100D END"
        " WHEN l_suppkey % 2 = 0 THEN CASE i % 4 WHEN 0 THEN 0.1D WHEN 1 THEN 0D WHEN 2 THEN 0.03D ELSE 0.07D END"
        " ELSE CASE WHEN i < 2 + 4 * (l_suppkey % 19) THEN 0.01D ELSE 0.02D END END AS l_discount",
        "CASE WHEN i < 2 + 4 * (l_suppkey % 19) THEN 0.07D ELSE 0.08D END AS l_tax",
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(n).selectExpr("id AS s_suppkey", "CAST(0 AS INT) AS s_nationkey").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.sql("SELECT 0 AS n_nationkey, 0 AS n_regionkey").write.parquet(str(tmp_path / "nation.parquet"))
    spark.sql("SELECT 0 AS r_regionkey, 'EUROPE' AS r_name").write.parquet(str(tmp_path / "region.parquet"))
    con = duckdb.connect()
    for t in ("lineitem", "supplier", "nation", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(entry_module.oracle_sql()[name]).fetchdf().sort_values("district_id").reset_index(drop=True)
    got = entry_module.queries()[name](spark, str(tmp_path)).toPandas().sort_values("district_id").reset_index(drop=True)
    assert len(want) == n and got[list(want.columns)].equals(want)
    # 0.05 * 5 reaches the threshold, so no high share is below it and an equal one is no upgrade.
    if name == "j14_max_merge":
        assert (got.f_high >= 0.25).all() and not got.f_high_upgraded[got.district_id % 2 == 0].any()
