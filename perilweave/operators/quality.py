"""Ingest gates and checks of results against their own identities."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def completeness_gate(df: DataFrame, expected: DataFrame | int | None) -> DataFrame:
    """One status row; an unknown expectation counts as incomplete."""
    if isinstance(expected, DataFrame):
        want = expected.scalar()
    else:
        want = F.lit(expected).cast("long")
    found = df.agg(F.count(F.lit(1)).alias("found"))
    return found.select(
        "found", want.alias("expected"),
        F.when(want.isNotNull() & (F.col("found") == want), "complete").otherwise("incomplete").alias("status"),
    )


def verify_layers(df: DataFrame, layer: str, expected: Mapping[str, int] | DataFrame) -> DataFrame:
    """Recount every layer on disk against what it must hold, absent layers included."""
    if not isinstance(expected, DataFrame):
        rows = [F.struct(F.lit(k).alias(layer), F.lit(v).cast("long").alias("expected")) for k, v in expected.items()]
        expected = df.sparkSession.range(1).select(F.inline(F.array(*rows)))
    counts = df.groupBy(layer).agg(F.count(F.lit(1)).alias("found"))
    return expected.join(counts, layer, "left").select(
        layer, F.coalesce("found", F.lit(0)).alias("found"), "expected",
        F.coalesce(F.col("found") == F.col("expected"), F.lit(False)).alias("ok"),
    )


def incremental_todo(points: DataFrame, done: DataFrame, keys: list[str], thin: int = 2) -> DataFrame:
    """Points not fetched yet, by rounded coordinates; every second one when resuming.

    Thinning keeps the order of the unique ``point_id``.
    """
    from .ordering import running

    on = {k: F.round(k, 0) for k in keys}
    left = points.withColumns({f"_{k}": c for k, c in on.items()})
    seen = done.select(*[on[k].alias(f"_{k}") for k in keys]).distinct()
    todo = left.join(seen, [f"_{k}" for k in keys], "left_anti").drop(*[f"_{k}" for k in keys])
    resuming = done.agg((F.count(F.lit(1)) > 0).alias("r")).scalar()
    ranked = running(todo, "point_id", "point_id", rank="_rn")
    return ranked.where(~resuming | ((F.col("_rn") - 1) % thin == 0)).drop("_rn")


def no_nan_gate(df: DataFrame) -> DataFrame:
    """One row: NaN values over all numeric columns (must be 0) and the row count."""
    numeric = [c for c, t in df.dtypes if t in ("double", "float")]
    bad = sum((F.count_if(F.isnan(c)) for c in numeric), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("rows"), bad.cast("long").alias("nan_values"))


def result_identities(df: DataFrame) -> DataFrame:
    """One row per identity a rated table has to satisfy, with its violations.

    Uses unrounded values. Group checks compare extremes of neighbouring groups.
    """
    by_group = df.groupBy("group").agg(
        F.count(F.lit(1)).alias("n"), F.min("premium").alias("lo"), F.max("premium").alias("hi")
    )
    n = by_group.withColumnRenamed("group", "g")
    after = n.select((F.col("g") - 1).alias("g"), F.col("lo").alias("next_lo"))
    groups = n.join(after, "g", "left").agg(
        F.count_if(F.col("hi") > F.col("next_lo") + 1e-6).alias("monotone"),
        F.when(F.max("n") - F.min("n") > 2, 1).otherwise(0).cast("long").alias("balanced"),
    )
    broken = {
        "premium": "abs(premium - el_total - capital) > 1e-6",
        "total": "abs(el_total - el_sub - el_wx - el_fl - el_gw) > 1e-6",
        "capital": "capital < -1e-9",
        "tail_order": "tvar99 < var995 - 1e-6",
        "nesting": "f_low < f_high - 1e-9 OR sw_low < sw_high - 1e-9",
        "tail_dependence": "abs(tail_dep_fl - (2 - pow(2D, 1 / theta_fl))) > 1e-9",
        "uncovered_uplift": "cc_covered = 0 AND cc_uplift_pct <> 0",
    }
    rows = df.agg(*[F.count_if(F.expr(e)).alias(k) for k, e in broken.items()])
    out = lambda r, names: r.select(
        F.inline(F.array(*[F.struct(F.lit(k).alias("identity"), F.col(k).alias("violations")) for k in names]))
    )
    return out(rows, list(broken)).unionByName(out(groups, ["monotone", "balanced"]))
