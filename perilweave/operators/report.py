"""Published tables: rounding policy, lookups, top lists, headline figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import as_scalar, quantiles

# Decimals of published columns that do not follow the name rules.
DECIMALS = {
    "wind_ms": 1, "wdr_idx": 1, "rain10_days": 1, "precip_mm": 0, "gust_rp50": 0,
    "households": 0, "sw_depth_m": 2,
}
AS_IS = ("name", "area", "country", "geometry", "group", "geol", "sup_geol")
CLIMATE_COLUMNS = ("el_total_cc", "capital_cc", "premium_cc", "cc_uplift_pct")
PERIL_NAMES = {"fl": "flood", "sub": "subsidence", "wx": "weather", "gw": "groundwater"}
DRIVER_SHARE = 0.18
CSV_COLUMNS = (
    "name", "area", "households", "group", "premium", "capital", "el_total",
    "el_sub", "el_wx", "el_fl", "el_gw", "sub_score", "wx_score", "fl_score", "gw_score",
    "f_high", "f_low", "sw_high", "sw_low", "gw_frac", "sw_depth_m", "sw_sev",
    "wind_ms", "gust_rp50", "rain10_days", "precip_mm",
    "tvar99_vine", "tvar99_euler", "uplift_pct",
    "el_er", "er_score", "er_smp55", "er_smp105", "er_nfi55", "er_nfi105",
    "er_smp105_lo", "er_smp105_hi", "er_nfi105_lo", "er_nfi105_hi", "er_gi",
    "cc_covered", "premium_cc", "el_total_cc", "cc_uplift_pct",
    "country", "geol", "sup_geol", "sup_frac",
)


def decimals_of(column: str) -> int | None:
    """Published decimals; the order of the rules matters (``tvar`` holds ``var``)."""
    if column in AS_IS:
        return None
    if column in DECIMALS:
        return DECIMALS[column]
    if "var" in column or column.startswith("el") or column == "premium":
        return 1
    return 7 if column.startswith("er_") else 4


def publish_rounded(df: DataFrame) -> DataFrame:
    """Round half-even per column, leave text and group alone."""
    numeric = {c for c, t in df.dtypes if t in ("double", "float")}
    return df.select(
        *[
            F.bround(c, decimals_of(c)).alias(c) if c in numeric and decimals_of(c) is not None else F.col(c)
            for c in df.columns
        ]
    )


def fill_undefined(df: DataFrame) -> DataFrame:
    """Undefined depth and climate values go out as 0; ``cc_covered`` keeps them readable."""
    present = [c for c in ("sw_depth_m", *CLIMATE_COLUMNS) if c in df.columns]
    return df.fillna(0.0, present)


def export_table(df: DataFrame, columns=CSV_COLUMNS) -> DataFrame:
    """Fixed column list, absent columns and values empty, sorted by name."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns]
    return df.orderBy("name").select(*cols)


def export_lookup(df: DataFrame) -> DataFrame:
    """Compact search table sorted by name."""
    whole = {"p": "premium", "es": "el_sub", "ew": "el_wx", "ef": "el_fl", "eg": "el_gw", "c": "capital", "h": "households"}
    scores = {"s": "sub_score", "w": "wx_score", "f": "fl_score", "gw": "gw_score"}
    return df.orderBy("name").select(
        F.col("name").alias("n"), F.col("group").cast("int").alias("g"),
        *[F.bround(c, 0).cast("long").alias(a) for a, c in whole.items()],
        *[F.bround(c, 2).alias(a) for a, c in scores.items()],
        F.bround("uplift_pct", 1).alias("u"),
    )


def loss_drivers(df: DataFrame, out: str = "driver") -> DataFrame:
    """Phrase that names the perils carrying at least 18% of the expected loss."""
    total = F.expr(" + ".join(f"el_{k}" for k in PERIL_NAMES))
    parts = F.array(
        *[
            F.struct((-F.col(f"el_{k}")).alias("size"), F.lit(i).alias("ord"), F.lit(n).alias("peril"))
            for i, (k, n) in enumerate(PERIL_NAMES.items())
        ]
    )
    df = df.withColumns({"_t": F.when(total == 0, 1.0).otherwise(total), "_r": F.array_sort(parts)})
    share = lambda p: -p["size"] / F.col("_t")
    df = df.withColumn("_n", F.filter("_r", lambda p: share(p) >= DRIVER_SHARE))
    df = df.withColumn("_n", F.when(F.size("_n") > 0, F.col("_n")).otherwise(F.slice("_r", 1, 1)))
    pct = lambda i: F.concat(F.bround(100 * share(F.col("_n")[i]), 0).cast("int").cast("string"), F.lit("%"))
    names = F.array_join(F.transform(F.slice("_n", 1, 3), lambda p: p["peril"]), " + ")
    cap = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))
    text = F.when(
        F.size("_n") == 1, F.concat(cap(F.col("_n")[0]["peril"]), F.lit("-dominated ("), pct(0), F.lit(" of E[loss])"))
    ).otherwise(F.concat(cap(names), F.lit(" ("), pct(0), F.lit(" / "), F.try_element_at(F.transform("_n", lambda p: F.concat(F.bround(100 * share(p), 0).cast("int").cast("string"), F.lit("%"))), F.lit(2)), F.lit(")")))
    return df.withColumn(out, text).drop("_t", "_r", "_n")


def top_by(df: DataFrame, value: str, n: int, key: str, ascending: bool = False) -> DataFrame:
    """The n rows with the largest (or smallest) value, smaller key on ties."""
    order = F.asc(value) if ascending else F.desc(value)
    return df.orderBy(order, F.asc(key)).limit(n)


def prefix_search(df: DataFrame, name: str, text: str, n: int = 12) -> DataFrame:
    """Names starting with the text: exact match, then shortest, then alphabetical."""
    wanted = text.strip().upper()
    hit = F.upper(F.col(name)).startswith(wanted)
    return (
        df.where(hit)
        .orderBy(F.desc(F.upper(F.col(name)) == wanted), F.length(name), F.asc(name))
        .limit(n)
    )


def net_change(df: DataFrame, present: str, future: str, covered: Column) -> DataFrame:
    """One row: growth of a share over covered districts, and how many shrank."""
    kept = df.where(covered)
    return kept.agg(
        F.try_divide(F.sum(future), F.sum(present)).alias("growth"),
        F.count_if(F.col(future) < F.col(present) - 1e-9).alias("shrank"),
        F.count(F.lit(1)).alias("covered"),
    )


def headline_stats(df: DataFrame) -> DataFrame:
    """One row of published figures from a rated table, in one aggregation."""
    w = F.col("households")
    mean = lambda c: F.sum(F.col(c) * w) / F.sum(w)
    cov = F.col("cc_covered") == 1
    on = lambda c: F.sum(F.when(cov, F.col(c) * w))
    exposed = F.col("er_nfi105") > 0
    return df.agg(
        F.count(F.lit(1)).alias("districts"),
        F.sum("households").alias("households"),
        F.min("premium").alias("premium_min"),
        F.max("premium").alias("premium_max"),
        F.avg("el_total").alias("mean_el"),
        F.avg("capital").alias("mean_capital"),
        F.avg("tvar99_vine").alias("mean_standalone"),
        F.avg("tvar99_euler").alias("portfolio_tvar"),
        (100 * mean("el_total") / mean("premium")).alias("el_share_pct"),
        (100 * mean("capital") / mean("premium")).alias("capital_share_pct"),
        (100 * (1 - F.avg("tvar99_euler") / F.avg("tvar99_vine"))).alias("diversification_pct"),
        F.avg("uplift_pct").alias("mean_uplift_pct"),
        F.count_if(exposed).alias("erosion_exposed"),
        F.count_if(exposed & (F.col("er_smp105") == 0)).alias("erosion_saved"),
        F.max_by("name", F.struct("er_smp105", -F.col("district_id"))).alias("erosion_worst"),
        F.count_if(cov).alias("cc_districts"),
        (100 * (on("premium_cc") / on("premium") - 1)).alias("cc_uplift_pct"),
        F.max_by("name", F.when(cov, F.struct("cc_uplift_pct", -F.col("district_id")))).alias("cc_worst"),
    )


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, spread, extremes and exact quartiles, one row a column (measure)."""
    cuts = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    quartiles = as_scalar(quantiles(df, {f"{c}_{n}": (c, p) for c in columns for n, p in cuts.items()}))
    found = {"n": F.count, "mean": F.avg, "spread": F.stddev_samp, "least": F.min, "most": F.max}
    measured = df.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in found.items()]).withColumn("_q", quartiles)
    return measured.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("measure"), *[F.col(f"{c}_{n}").alias(n) for n in found],
                        *[F.col(f"_q.{c}_{n}").alias(n) for n in cuts],
                    )
                    for c in columns
                ]
            )
        )
    )


def level_check(df: DataFrame, published: float, all_claims: float) -> DataFrame:
    """One row: modelled cost per policy against the published one."""
    m = F.avg("el_total")
    return df.agg(
        m.alias("modelled"), F.lit(published).alias("published"),
        (m / published - 1).alias("gap"), (m / all_claims).alias("share_of_all_claims"),
    )


def unpriced_exposure(df: DataFrame, value: str = "el_er", priced: str = "el_total") -> DataFrame:
    """One row about a peril that stays outside the premium."""
    mean = F.sum(F.col(value) * F.col("households")) / F.sum("households")
    return df.agg(
        mean.alias("per_policy"),
        (100 * mean / F.greatest(F.avg(priced), F.lit(1e-9))).alias("pct_of_priced"),
        F.count_if(F.col(value) > 0.5).alias("districts"),
        F.max(value).alias("worst"),
    )
