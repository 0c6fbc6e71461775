"""Keyed lookups whose missing values each have their own meaning.

"Not mapped" and "measured zero" are different facts, so every input names the
fallback for absent keys. Tables are joined as they come; Spark broadcasts the
ones it measures to be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import as_scalar, quantiles


def lookup(df: DataFrame, table: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Left equi-join that keeps every row of ``df``; absent keys give NULL."""
    return df.join(table.select(key, *values), key, "left")


def lookup_or_median(df: DataFrame, table: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Absent keys take the median of the values that were found."""
    found = lookup(df, table, key, values)
    medians = as_scalar(quantiles(found, {v: (v, 0.5) for v in values}))
    return found.withColumns({v: F.coalesce(F.col(v), medians[v]) for v in values})


def lookup_or_const(df: DataFrame, table: DataFrame, key: str, value: str, default) -> DataFrame:
    return lookup(df, table, key, [value]).withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def lookup_or_zero(df: DataFrame, table: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Absent keys and columns the table does not have (yet) count as zero."""
    present = [v for v in values if v in table.columns]
    found = lookup(df, table, key, present)
    return found.withColumns(
        {v: F.coalesce(F.col(v), F.lit(0.0)) if v in present else F.lit(0.0) for v in values}
    )


def lookup_or_percentile(
    df: DataFrame, table: DataFrame, key: str, value: str, q: float = 0.10, floor: float = 1.0
) -> DataFrame:
    """Absent keys take a low percentile of the found values; results have a floor."""
    found = lookup(df, table, key, [value])
    low = as_scalar(quantiles(found, {"low": (value, q)}))["low"]
    return found.withColumn(value, F.greatest(F.coalesce(F.col(value), low), F.lit(floor)))


def override_where_covered(
    base: DataFrame, future: DataFrame, key: str, values: list[str], covered: str
) -> DataFrame:
    """Take future values only for covered rows the future table holds."""
    renamed = future.select(key, *[F.col(v).alias(f"_f_{v}") for v in values], F.lit(True).alias("_has"))
    joined = base.join(renamed, key, "left")
    use = F.col(covered) & F.col("_has").isNotNull()
    return joined.withColumns(
        {v: F.when(use, F.col(f"_f_{v}")).otherwise(F.col(v)) for v in values}
    ).drop("_has", *[f"_f_{v}" for v in values])


def max_merge(
    base: DataFrame, patch: DataFrame, key: str, values: list[str], nest: tuple[str, str] | None = None
) -> DataFrame:
    """Per column take the patch where it is strictly greater; flag upgrades."""
    joined = base.join(patch.select(key, *[F.col(v).alias(f"_p_{v}") for v in values]), key, "left")
    out = {f"{v}_upgraded": F.coalesce(F.col(f"_p_{v}") > F.col(v), F.lit(False)) for v in values}
    joined = joined.withColumns(out).withColumns({v: F.greatest(F.col(v), F.col(f"_p_{v}")) for v in values})
    if nest:
        outer, inner = nest
        joined = joined.withColumn(outer, F.greatest(F.col(outer), F.col(inner)))
    return joined.drop(*[f"_p_{v}" for v in values])


def upsert_by_region(
    kept: DataFrame, fresh: DataFrame, key: str, region: str, values: list[str]
) -> DataFrame:
    """Replace re-run regions and keep the others, then add up over regions.

    Both tables hold one contribution per (key, region), so running a region
    twice replaces its share instead of adding it again. Sums are clipped to
    [0, 1].
    """
    stale = fresh.select(region).distinct()
    rows = kept.join(stale, region, "left_anti").unionByName(fresh.select(kept.columns))
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    return rows.groupBy(key).agg(*[clip(F.sum(v)).alias(v) for v in values])


def apportion(
    members: DataFrame, totals: DataFrame, area: str, target: str, total: str,
    pooled: Column | None = None, pooled_total: float = 0.0,
) -> DataFrame:
    """Share each area's total equally among its members and add up by target.

    Members whose area has no total take an equal part of ``pooled_total`` if
    ``pooled`` holds for them, otherwise they count as unmatched. Members are
    counted per (target, area) before any join, so an area with very many
    members travels as few rows.
    """
    cells = members.groupBy(target, area).agg(F.count(F.lit(1)).alias("_m"))
    sizes = cells.groupBy(area).agg(F.sum("_m").alias("_size"))
    rated = (
        sizes.join(totals.select(area, F.col(total).alias("_t")), area, "left")
        .withColumn("_each", F.col("_t") / F.col("_size"))
        .withColumn("_pool", (pooled if pooled is not None else F.lit(False)) & F.col("_t").isNull())
    )
    pool_members = as_scalar(rated.agg(F.sum(F.when(F.col("_pool"), F.col("_size"))).alias("n")))["n"]
    each = F.when(F.col("_pool"), F.lit(float(pooled_total)) / F.nullif(pool_members, F.lit(0))).otherwise(
        F.col("_each")
    )
    return (
        cells.join(rated.withColumn("_each", each), area)
        .groupBy(target)
        .agg(
            F.coalesce(F.sum(F.col("_m") * F.col("_each")), F.lit(0.0)).alias(total),
            F.sum("_m").alias("members"),
            F.sum(F.when(F.col("_each").isNull(), F.col("_m")).otherwise(0)).alias("unmatched"),
        )
    )


def label_or_default(df: DataFrame, labels: DataFrame, key: str, label: str, default: Column) -> DataFrame:
    return df.join(labels.select(key, label), key, "left").withColumn(
        label, F.coalesce(F.col(label), default)
    )


def nearest_return_period(curve: DataFrame, wanted: list[float], lo: float = 2.0, hi: float = 1000.0) -> DataFrame:
    """Curve point (period, loss) closest to each wanted period on a log scale.

    Ties go to the point that comes first, which is the longer period.
    """
    asked = F.explode(F.array(*[F.lit(float(w)) for w in wanted]))
    near = curve.where(F.col("period").between(lo, hi)).withColumn("wanted", asked)
    gap = F.abs(F.log10("period") - F.log10("wanted"))
    return near.groupBy("wanted").agg(
        F.min_by(F.struct("period", "loss"), F.struct(gap, -F.col("period"))).alias("p")
    ).select("wanted", "p.period", "p.loss")


def compare_groups(base: DataFrame, other: DataFrame, key: str, group: str) -> DataFrame:
    """Share of rows whose group differs between two runs, in percent."""
    both = base.select(key, F.col(group).alias("_a")).join(other.select(key, F.col(group).alias("_b")), key)
    return both.agg(
        (100 * F.avg((F.col("_a") != F.col("_b")).cast("double"))).alias("churn_pct"),
        F.count(F.lit(1)).alias("compared"),
    )


def diff_results(a: DataFrame, b: DataFrame, key: str | list[str], values: list[str]) -> DataFrame:
    """Per column: keys on one side only, differing values, largest difference.

    NULL equals NULL. Returns one row per column.
    """
    keys = [key] if isinstance(key, str) else key
    left = a.select(*keys, *[F.col(v).cast("double").alias(f"a_{v}") for v in values], F.lit(True).alias("_a"))
    right = b.select(*keys, *[F.col(v).cast("double").alias(f"b_{v}") for v in values], F.lit(True).alias("_b"))
    both = left.join(right, keys, "full_outer")
    matched = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    one_side = F.count_if(~matched).alias("missing_keys")
    parts = []
    for v in values:
        x, y = F.col(f"a_{v}"), F.col(f"b_{v}")
        parts.append(
            F.struct(
                F.lit(v).alias("column"),
                F.col("missing_keys"),
                F.col(f"n_{v}").alias("differing"),
                F.coalesce(F.col(f"d_{v}"), F.lit(0.0)).alias("max_abs_diff"),
            )
        )
    stats = both.agg(
        one_side,
        *[
            F.count_if(matched & ~F.col(f"a_{v}").eqNullSafe(F.col(f"b_{v}"))).alias(f"n_{v}")
            for v in values
        ],
        *[F.max(F.when(matched, F.abs(F.col(f"a_{v}") - F.col(f"b_{v}")))).alias(f"d_{v}") for v in values],
    )
    return stats.select(F.inline(F.array(*parts)))
