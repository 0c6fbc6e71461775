"""Registry of queries, and the domain tables they derive from the driver's tables.

A domain table is one SELECT that Spark and DuckDB both run, so a query and its
oracle start from the same rows; everything after that is written twice.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, wraps
from string import Formatter

from pyspark.sql import DataFrame, SparkSession

from ..session import materialize

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
YEARS = 1000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


# Tables written once for the query that is being built, by what they hold.
_STAGES: dict[tuple, DataFrame] = {}


def staged(key: tuple, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` gives, written once for all its readers in the running query."""
    if key not in _STAGES:
        _STAGES[key] = materialize(build(), str(key[0]))
    return _STAGES[key]


def query(name: str, oracle: str | None = None):
    def register(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            _STAGES.clear()
            try:
                return fn(spark, sf)
            finally:
                _STAGES.clear()

        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


INPUTS: dict[str, str] = {
    # household count of a district: customers of its nation
    "exposure": """
        SELECT s_suppkey AS district_id, CAST(1 + coalesce(n, 0) AS DOUBLE) AS households
        FROM {supplier} LEFT JOIN
          (SELECT c_nationkey, count(*) AS n FROM {customer} GROUP BY c_nationkey) c
          ON s_nationkey = c_nationkey""",
    # realised losses by district, year and peril
    "ylt": """
        SELECT district_id, year_id, peril, round(sum(loss), 4) AS loss FROM (
          SELECT l_suppkey AS district_id, l_orderkey % 1000 AS year_id,
            CASE l_linenumber % 4 WHEN 0 THEN 'wx' WHEN 1 THEN 'fl' WHEN 2 THEN 'sub' ELSE 'gw' END AS peril,
            CASE WHEN l_returnflag = 'R' THEN l_extendedprice * (1 - l_discount) ELSE 0e0 END AS loss
          FROM {lineitem}) x
        GROUP BY district_id, year_id, peril""",
    # the same with erosion as a fifth peril
    "ylt5": """
        SELECT district_id, year_id, peril, round(sum(loss), 4) AS loss FROM (
          SELECT l_suppkey AS district_id, l_orderkey % 1000 AS year_id,
            CASE l_linenumber % 5 WHEN 0 THEN 'wx' WHEN 1 THEN 'fl' WHEN 2 THEN 'sub' WHEN 3 THEN 'gw' ELSE 'er' END AS peril,
            CASE WHEN l_returnflag = 'R' THEN l_extendedprice * (1 - l_discount) ELSE 0e0 END AS loss
          FROM {lineitem}) x
        GROUP BY district_id, year_id, peril""",
    # a second run of the same model: other lines claim
    "ylt_indep": """
        SELECT district_id, year_id, peril, round(sum(loss), 4) AS loss FROM (
          SELECT l_suppkey AS district_id, l_orderkey % 1000 AS year_id,
            CASE l_linenumber % 4 WHEN 0 THEN 'wx' WHEN 1 THEN 'fl' WHEN 2 THEN 'sub' ELSE 'gw' END AS peril,
            CASE WHEN l_returnflag = 'A' THEN l_extendedprice * (1 - l_discount) ELSE 0e0 END AS loss
          FROM {lineitem}) x
        GROUP BY district_id, year_id, peril""",
    # scored districts: the columns the simulation reads
    "scored": """
        SELECT s_suppkey AS district_id, s_name AS name, concat('A', CAST(s_nationkey AS STRING)) AS area,
          5e-2 + 95e-2 * ((s_suppkey * 37) % 1009) / 1008e0 AS sub_score,
          5e-2 + 95e-2 * ((s_suppkey * 53 + 7) % 997) / 996e0 AS wx_score,
          ((s_suppkey * 71 + 3) % 991) / 990e0 AS fl_score,
          ((s_suppkey * 83 + 5) % 983) / 982e0 AS gw_score,
          8e-1 * ((s_suppkey * 89 + 1) % 977) / 976e0 AS er_score,
          4e-1 * ((s_suppkey * 29) % 971) / 970e0 AS f_high,
          4e-1 * ((s_suppkey * 29) % 971) / 970e0 + 2e-1 * ((s_suppkey * 31) % 967) / 966e0 AS f_low,
          3e-1 * ((s_suppkey * 41) % 953) / 952e0 AS sw_high,
          3e-1 * ((s_suppkey * 41) % 953) / 952e0 + 2e-1 * ((s_suppkey * 43) % 947) / 946e0 AS sw_low,
          5e-1 * ((s_suppkey * 47) % 941) / 940e0 AS gw_frac,
          6e-1 + 19e-1 * ((s_suppkey * 59) % 937) / 936e0 AS sw_sev,
          5e-2 * ((s_suppkey * 61) % 929) / 928e0 AS er_frac,
          125e-3 * ((s_suppkey * 67) % 929) / 928e0 AS er_nfi105,
          households
        FROM {supplier} JOIN {exposure} e ON s_suppkey = e.district_id""",
    # country and the share of the district inside it
    "country": """
        SELECT s_suppkey AS district_id, r_name AS country, (90 + s_suppkey % 11) / 100e0 AS share
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    # polygons: districts 30 apart, zones 7 apart, both growing northwards with the data
    "district_corners": """
        SELECT district_id, cx - r AS x1, cy - 3e-1 * r AS y1, cx + 2e-1 * r AS x2, cy - r AS y2,
          cx + r AS x3, cy + 4e-1 * r AS y3, cx - 1e-1 * r AS x4, cy + 9e-1 * r AS y4 FROM (
          SELECT s_suppkey AS district_id, 15 + 30e0 * (s_suppkey % 40) AS cx,
            15 + 30e0 * floor(s_suppkey / 40e0) AS cy, 140291e-4 + s_suppkey % 7 AS r FROM {supplier}) k""",
    "zone_corners": """
        SELECT zone_id, kind, layer, cx - r AS x1, cy - 3e-1 * r AS y1, cx + 2e-1 * r AS x2, cy - r AS y2,
          cx + r AS x3, cy + 4e-1 * r AS y3, cx - 1e-1 * r AS x4, cy + 9e-1 * r AS y4 FROM (
          SELECT p_partkey AS zone_id, p_type AS kind, p_brand AS layer, 3 + 7e0 * (p_partkey % 171) AS cx,
            3 + 7e0 * floor(p_partkey / 171e0) AS cy, 30137e-4 + p_partkey % 5 AS r FROM {part}) k""",
    "region_corners": """
        SELECT n_nationkey AS region_id, r_name AS country, 48e0 * n_nationkey AS x1, -60e0 AS y1,
          48e0 * (n_nationkey + 1) AS x2, -60e0 AS y2, 48e0 * (n_nationkey + 1) + 10 AS x3, top AS y3,
          48e0 * n_nationkey + 10 AS x4, top AS y4
        FROM (SELECT n_nationkey, r_name, (SELECT 60 + 30e0 * ceil(count(*) / 40e0) FROM {supplier}) AS top
              FROM {nation} JOIN {region} ON n_regionkey = r_regionkey) k""",
    # weather grid points
    "grid": """
        SELECT vec_id AS point_id, 600 + 1500 * CAST({elem0} AS DOUBLE) AS x,
          100 + 600 * CAST({elem1} AS DOUBLE) AS y, 10 + 5 * CAST({elem2} AS DOUBLE) AS wind,
          200 + 90 * CAST({elem3} AS DOUBLE) AS wdr, 30 + 20 * CAST({elem4} AS DOUBLE) AS rain10,
          900 + 300 * CAST({elem5} AS DOUBLE) AS precip, 120 + 30 * CAST({elem6} AS DOUBLE) AS gust_rp50
        FROM {embeddings}""",
    # decoded raster pixels: one row per tile, layer, row and column
    "pixels": """
        SELECT tile_id, layer, px_row, px_col, max(r) AS r, max(g) AS g, max(b) AS b, max(a) AS a FROM (
          SELECT l_suppkey AS tile_id, l_linestatus AS layer, l_orderkey % 30 AS px_row, l_partkey % 30 AS px_col,
            80 + (l_partkey * 7 + l_orderkey) % 121 AS r, 90 + (l_partkey * 11 + l_orderkey) % 136 AS g,
            150 + (l_partkey * 3 + l_orderkey) % 106 AS b, (l_orderkey * 13 + l_partkey) % 64 AS a
          FROM {lineitem}) p
        GROUP BY tile_id, layer, px_row, px_col""",
    "tiles": """
        SELECT s_suppkey AS tile_id, 30e0 * (s_suppkey % 40) AS minx, 30e0 * floor(s_suppkey / 40e0) AS miny,
          30e0 * (s_suppkey % 40) + 30 AS maxx, 30e0 * floor(s_suppkey / 40e0) + 30 AS maxy FROM {supplier}""",
    # daily weather of a station
    "daily": """
        SELECT l_suppkey % 12 AS point_id, CAST(l_shipdate AS DATE) AS day,
          round(max(l_extendedprice) / 1000, 3) AS gust, sum(l_quantity) AS rain,
          round(avg(l_discount), 6) * 300 AS tmax
        FROM {lineitem} GROUP BY l_suppkey % 12, CAST(l_shipdate AS DATE)""",
}


@lru_cache(maxsize=None)
def _needs(name: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(f for _, f, _, _ in Formatter().parse(INPUTS[name]) if f))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _element(i: int, spark: bool) -> str:
    return f"embedding[{i if spark else i + 1}]"


def load_input(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table, or a domain table that is derived once per query."""
    if name in TABLES:
        return table(spark, sf, name)
    return staged((name, sf), lambda: _derived(spark, sf, name))


def _derived(spark: SparkSession, sf: str, name: str) -> DataFrame:
    parts, text = {}, INPUTS[name]
    for need in _needs(name):
        if need.startswith("elem"):
            text = text.replace("{" + need + "}", _element(int(need[4:]), True))
        else:
            parts[need] = load_input(spark, sf, need)
    return spark.sql(text, **parts)


def sql(inputs: list[str] | str, body: str) -> str:
    """Oracle text: the named domain tables as CTEs, then ``body``."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in TABLES or name in done or name.startswith("elem"):
            return
        for need in _needs(name):
            add(need)
        text = INPUTS[name]
        for need in _needs(name):
            text = text.replace(
                "{" + need + "}", _element(int(need[4:]), False) if need.startswith("elem") else need
            )
        done[name] = text

    for name in [inputs] if isinstance(inputs, str) else inputs:
        add(name)
    body = body.strip()
    ctes = ",\n".join(f"{n} AS ({t})" for n, t in done.items())
    if not ctes:
        return body if body.upper().startswith("SELECT") else "WITH " + body
    return f"WITH {ctes}" + ("\n" if body.upper().startswith("SELECT") else ",\n") + body


def rings(df: DataFrame) -> DataFrame:
    """Corner columns x1..y4 as a one-ring polygon."""
    from pyspark.sql import functions as F

    corners = [F.struct(F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y")) for i in (1, 2, 3, 4)]
    keep = [c for c in df.columns if c[0] not in "xy" or not c[1:].isdigit()]
    return df.select(*keep, F.array(F.array(*corners)).alias("rings"))


# Oracle side of the same polygons: one row per edge, and area by the shoelace rule.
def edge_cte(name: str, source: str, key: str) -> str:
    sides = " UNION ALL ".join(
        f"SELECT {key}, x{i} AS xs, y{i} AS ys, x{j} AS xe, y{j} AS ye FROM {source}"
        for i, j in ((1, 2), (2, 3), (3, 4), (4, 1))
    )
    return f"{name} AS ({sides})"


def area_expr() -> str:
    return "(" + " + ".join(
        f"(x{i} * y{j} - x{j} * y{i})" for i, j in ((1, 2), (2, 3), (3, 4), (4, 1))
    ) + ") / 2"


def overlap_cte(name: str, a: str, b: str, a_key: str, b_key: str) -> str:
    """Shared area of two corner tables, all boxes compared, whole edges."""
    return f"""{edge_cte(name + '_ea', a, a_key)}, {edge_cte(name + '_eb', b, b_key)},
    {name}_box AS (
      SELECT a.{a_key}, b.{b_key},
        least((greatest(a.x1, a.x2, a.x3, a.x4) - least(a.x1, a.x2, a.x3, a.x4)) * (greatest(a.y1, a.y2, a.y3, a.y4) - least(a.y1, a.y2, a.y3, a.y4)),
          (greatest(b.x1, b.x2, b.x3, b.x4) - least(b.x1, b.x2, b.x3, b.x4)) * (greatest(b.y1, b.y2, b.y3, b.y4) - least(b.y1, b.y2, b.y3, b.y4))) AS box,
        least(a.y1, a.y2, a.y3, a.y4, b.y1, b.y2, b.y3, b.y4) AS base
      FROM {a} a JOIN {b} b
        ON least(a.x1, a.x2, a.x3, a.x4) < greatest(b.x1, b.x2, b.x3, b.x4)
       AND least(b.x1, b.x2, b.x3, b.x4) < greatest(a.x1, a.x2, a.x3, a.x4)
       AND least(a.y1, a.y2, a.y3, a.y4) < greatest(b.y1, b.y2, b.y3, b.y4)
       AND least(b.y1, b.y2, b.y3, b.y4) < greatest(a.y1, a.y2, a.y3, a.y4)),
    {name}_met AS (
      SELECT p.{a_key}, p.{b_key}, p.base, p.box, e.xs AS axs, e.ys AS ays, e.xe AS axe, e.ye AS aye,
        f.xs AS bxs, f.ys AS bys, f.xe AS bxe, f.ye AS bye,
        greatest(least(e.xs, e.xe), least(f.xs, f.xe)) AS lo,
        least(greatest(e.xs, e.xe), greatest(f.xs, f.xe)) AS hi
      FROM {name}_box p JOIN {name}_ea e ON e.{a_key} = p.{a_key} JOIN {name}_eb f ON f.{b_key} = p.{b_key}
      WHERE e.xs <> e.xe AND f.xs <> f.xe),
    {name}_h AS (
      SELECT {a_key}, {b_key}, box, hi - lo AS w, sign(axs - axe) * sign(bxs - bxe) AS sgn,
        ays + (aye - ays) * (lo - axs) / (axe - axs) - base AS f0,
        ays + (aye - ays) * (hi - axs) / (axe - axs) - base AS f1,
        bys + (bye - bys) * (lo - bxs) / (bxe - bxs) - base AS g0,
        bys + (bye - bys) * (hi - bxs) / (bxe - bxs) - base AS g1
      FROM {name}_met WHERE lo < hi),
    {name} AS (
      SELECT {a_key}, {b_key}, sum(sgn * (CASE
          WHEN f0 <= g0 AND f1 <= g1 THEN w * (f0 + f1) / 2
          WHEN f0 >= g0 AND f1 >= g1 THEN w * (g0 + g1) / 2
          WHEN f0 < g0 THEN w * (g0 + g1) / 2 + w * (f0 - g0) * (f0 - g0) / (2 * (f0 - g0 - f1 + g1))
          ELSE w * (g0 + g1) / 2 + w * (f1 - g1) * (f1 - g1) / (2 * (f1 - g1 - f0 + g0)) END)) AS overlap
      FROM {name}_h GROUP BY {a_key}, {b_key} HAVING overlap > 1e-12 * min(box))"""
