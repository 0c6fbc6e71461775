"""District scores from hazard layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import vocabulary as V
from ..operators import lookup as L
from ..operators import nearest as N
from ..operators import spatial as S
from ..operators.ordering import as_scalar, quantiles
from ..session import materialize

KEY = "district_id"


def unit(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def percentile_scale(df: DataFrame, columns: list[str], lo: float = 0.05, hi: float = 0.95) -> DataFrame:
    """Stretch each column between two of its own percentiles, clipped to [0, 1]."""
    wanted = {f"{c}_{s}": (c, q) for c in columns for s, q in (("lo", lo), ("hi", hi))}
    edge = as_scalar(quantiles(df, wanted))
    return df.withColumns(
        {c: unit(F.try_divide(F.col(c) - edge[f"{c}_lo"], edge[f"{c}_hi"] - edge[f"{c}_lo"])) for c in columns}
    )


def sqrt_anchor(
    df: DataFrame, value: str, q: float, out: str, least: float = 1e-6, anchor: Column | float | None = None
) -> DataFrame:
    """Square root of the share of a high percentile; a given anchor pins the scale."""
    if anchor is None:
        anchor = F.greatest(as_scalar(quantiles(df, {"a": (value, q)}))["a"], F.lit(least))
    elif not isinstance(anchor, Column):
        anchor = F.lit(float(anchor))
    return df.withColumn(out, unit(F.sqrt(F.col(value) / anchor)))


# --- flood ------------------------------------------------------------------

def flood_index() -> Column:
    """Fixed weights of the four flood bands; surface water counts for less."""
    return F.expr(
        "(75e-2 * f_high + 25e-2 * f_low) + 6e-1 * (75e-2 * sw_high + 25e-2 * sw_low)"
    )


def flood_anchor(df: DataFrame) -> Column:
    """95th percentile of the present-day index, to be pinned in a future run."""
    return F.greatest(as_scalar(quantiles(df.withColumn("_i", flood_index()), {"a": ("_i", 0.95)}))["a"], F.lit(1e-6))


def flood_score(df: DataFrame, anchor: Column | float | None = None) -> DataFrame:
    return sqrt_anchor(df.withColumn("_i", flood_index()), "_i", 0.95, "fl_score", 1e-6, anchor).drop("_i")


def groundwater_score(df: DataFrame, table: DataFrame, key: str = KEY, background: float = 0.02) -> DataFrame:
    found = L.lookup_or_const(df, table, key, "gw_frac", background)
    return sqrt_anchor(found, "gw_frac", 0.97, "gw_score")


EROSION_COLUMNS = (
    "er_smp55", "er_smp105", "er_nfi55", "er_nfi105",
    "er_smp105_lo", "er_smp105_hi", "er_nfi105_lo", "er_nfi105_hi", "er_gi",
)


def erosion_score(df: DataFrame, table: DataFrame, key: str = KEY) -> DataFrame:
    """Erosion fractions, zero where not mapped, and the planned-defence score."""
    found = L.lookup_or_zero(df, table, key, list(EROSION_COLUMNS))
    return sqrt_anchor(found, "er_smp105", 0.995, "er_score", 1e-9)


# --- surface-water depth ----------------------------------------------------

# Depth bands (key of the mask at their lower edge, metres), the
# damage relativity of each band, and claim weights of the two likelihoods.
DEPTH_KEYS = ("d02", "d03", "d06", "d09", "d12")
DEPTH_EDGES = (0.0, 0.2, 0.3, 0.6, 0.9, 1.2, 1.8)
DEPTH_DAMAGE = (0.45, 0.75, 1.00, 1.35, 1.60, 1.95)
FREQUENCY_HIGH, FREQUENCY_LOW = 0.010, 0.002


def running_max_reverse(columns: list[str]) -> list[Column]:
    """Each column is at least every column after it."""
    return [F.greatest(*[F.col(c) for c in columns[i:]]) if i < len(columns) - 1 else F.col(columns[i]) for i in range(len(columns))]


def band_shares(df: DataFrame, envelope: str, nested: list[str], prefix: str) -> DataFrame:
    """Area held by each depth band of a nested set, shallowest first."""
    edges = running_max_reverse([envelope, *nested])
    df = df.withColumns({f"_e{i}": e for i, e in enumerate(edges)})
    last = len(edges) - 1
    bands = {f"{prefix}{i}": F.col(f"_e{i}") - F.col(f"_e{i + 1}") for i in range(last)}
    bands[f"{prefix}{last}"] = F.col(f"_e{last}")
    return df.withColumns(bands).drop(*[f"_e{i}" for i in range(last + 1)])


def _raw_depth(df: DataFrame, depth: DataFrame | None, covered: str, key: str) -> DataFrame:
    names = [f"{k}_{b}" for k in DEPTH_KEYS for b in ("high", "low")]
    if depth is None:
        return df.withColumns({"_mult": F.lit(None).cast("double"), "_depth": F.lit(None).cast("double")})
    df = L.lookup_or_zero(df, depth, key, names)
    df = band_shares(df, "sw_high", [f"{k}_high" for k in DEPTH_KEYS], "_h")
    df = band_shares(df, "sw_low", [f"{k}_low" for k in DEPTH_KEYS], "_l")
    n = len(DEPTH_DAMAGE)
    df = df.withColumns({f"_l{i}": F.greatest(F.col(f"_l{i}") - F.col(f"_h{i}"), F.lit(0.0)) for i in range(n)})
    total = lambda p: sum((F.col(f"{p}{i}") for i in range(n)), F.lit(0.0))
    df = df.withColumns({"_sh": total("_h"), "_sl": total("_l")})
    # a band set counts by its contribution to claims: weight x its own shares
    df = df.withColumn("_w", F.greatest(FREQUENCY_HIGH * F.col("_sh") + FREQUENCY_LOW * F.col("_sl"), F.lit(1e-15)))
    share = {
        f"_b{i}": (FREQUENCY_HIGH * F.col(f"_h{i}") + FREQUENCY_LOW * F.col(f"_l{i}")) / F.col("_w") for i in range(n)
    }
    df = df.withColumns(share).withColumn("_tot", total("_b"))
    have = F.col(covered) & (F.col("_tot") > 1e-9)
    mids = [(a + b) / 2 for a, b in zip(DEPTH_EDGES, DEPTH_EDGES[1:])]
    mean = lambda v: sum((F.col(f"_b{i}") * F.lit(v[i]) for i in range(n)), F.lit(0.0)) / F.col("_tot")
    df = df.withColumns({"_mult": F.when(have, mean(DEPTH_DAMAGE)), "_depth": F.when(have, mean(mids))})
    return df.drop("_sh", "_sl", "_w", "_tot", *[f"_{p}{i}" for p in "hlb" for i in range(n)], *names)


def depth_reference(df: DataFrame, depth: DataFrame | None, covered: str = "covered", key: str = KEY) -> Column:
    """Exposure-weighted mean of the raw multiplier; 1 where nothing is mapped."""
    raw = _raw_depth(df, depth, covered, key)
    weight = F.sum(F.when(F.col("_mult").isNotNull(), F.col("households")))
    mean = F.try_divide(F.sum(F.col("_mult") * F.col("households")), weight)
    return F.greatest(raw.agg(F.coalesce(mean, F.lit(1.0)).alias("r")).scalar(), F.lit(1e-9))


def depth_severity(
    df: DataFrame, depth: DataFrame | None, covered: str = "covered",
    reference: Column | float | None = None, key: str = KEY,
) -> DataFrame:
    """Severity multiplier ``sw_sev`` and mean depth ``sw_depth_m``.

    The multiplier averages 1 over mapped exposure, or is expressed on a
    pinned present-day reference. Outside the mapped country it is 1.
    """
    if reference is None:
        reference = depth_reference(df, depth, covered, key)
    elif not isinstance(reference, Column):
        reference = F.lit(float(reference))
    raw = _raw_depth(df, depth, covered, key)
    return raw.withColumns(
        {
            "sw_sev": F.coalesce(F.col("_mult") / reference, F.lit(1.0)),
            "sw_depth_m": F.col("_depth"),
        }
    ).drop("_mult", "_depth")


# --- weather ----------------------------------------------------------------

# Weight of each component with and without extreme gusts.
WITH_GUSTS = {"wind": 0.30, "wdr": 0.25, "gust_rp50": 0.20, "rain10": 0.15, "precip": 0.10}
WITHOUT_GUSTS = {"wind": 0.35, "wdr": 0.30, "rain10": 0.20, "precip": 0.15}


def weather_score(
    targets: DataFrame, grids: list[tuple[DataFrame, list[str]]], key: str = KEY, k: int = 4, use_gusts: bool = True
) -> DataFrame:
    """Interpolated weather values and their weighted score.

    ``grids`` pairs a table (point_id, x, y, values) with the values it holds;
    values that share a grid share one neighbour search. Whether gusts count is
    the caller's choice (the published scores use them from 60 grid points on);
    without them the weights are those without gusts.
    """
    out = targets.select(key)
    for points, values in grids:
        values = [v for v in values if use_gusts or v != "gust_rp50"]
        if not values:
            continue
        near = N.knn_join(targets.select(key, "x", "y"), points.select("point_id", "x", "y"), key, "point_id", k)
        out = out.join(N.idw(near, points, key, "point_id", values), key)
    # read for the percentiles and for the scores
    out = materialize(out, "interpolated")
    weights = WITH_GUSTS if "gust_rp50" in out.columns else WITHOUT_GUSTS
    scaled = percentile_scale(
        out.select("*", *[F.col(c).alias(f"_s_{c}") for c in weights]), [f"_s_{c}" for c in weights]
    )
    score = sum((F.lit(w) * F.col(f"_s_{c}") for c, w in weights.items()), F.lit(0.0))
    scaled = scaled.withColumn("wx_score", unit(score)).drop(*[f"_s_{c}" for c in weights])
    if "gust_rp50" not in scaled.columns:
        scaled = scaled.withColumn("gust_rp50", F.lit(None).cast("double"))
    return scaled


# --- subsidence -------------------------------------------------------------

def bedrock_score(districts: DataFrame, bedrock: DataFrame, cell: float, key: str = KEY, susc: Column | None = None) -> DataFrame:
    """Area-weighted susceptibility and dominant clay; the nearest rock where none overlaps.

    ``bedrock`` has zone_id, lex_d, rcs_d, max_period and rings.
    """
    if susc is None:
        susc = R.classify_keywords(F.col("lex_d"), F.col("rcs_d"), F.col("max_period"))
    rock = bedrock.withColumn("susc", susc)
    facts = rock.select("zone_id", "lex_d", "susc")
    clay = F.when(F.col("susc") >= V.CLAY_FROM, F.round("overlap", 6)).otherwise(0.0)
    scored = (
        S.overlay_area(districts, rock, key, "zone_id", cell)
        .join(facts, "zone_id")
        .groupBy(key)
        .agg(
            S.area_weighted_mean(None, None, "susc").alias("bed_score"),
            S.dominant_category("lex_d", clay, F.col("zone_id")).alias("geol"),
        )
    )
    # read for the districts without rock and for the scores
    scored = materialize(scored, "bedrock")
    lonely = districts.join(scored.select(key), key, "left_anti")
    near = N.nearest_polygon(lonely, rock, key, "zone_id").join(facts, "zone_id").select(
        key, F.col("susc").alias("bed_score"), F.lit(None).cast("string").alias("geol")
    )
    return scored.unionByName(near).fillna(V.NO_CLAY, ["geol"])


def drift_score(
    districts: DataFrame, drift: DataFrame | None, cell: float, key: str = KEY,
    known=V.DEPOSITS, left_out=V.DEPOSITS_LEFT_OUT,
) -> DataFrame:
    """Susceptibility, cover and dominant name of classified superficial deposits."""
    base = districts.select(key, S.ring_area().alias("area"))
    if drift is None:
        return base.select(key, F.lit(0.0).alias("sup_score"), F.lit(0.0).alias("sup_frac"), F.lit("").alias("sup_geol"))
    kept = R.classify_closed(drift, "lex_d", known, left_out).withColumn("lex_d", F.upper(F.trim("lex_d")))
    scored = (
        S.overlay_area(districts, kept, key, "zone_id", cell)
        .join(kept.select("zone_id", "lex_d", "susc"), "zone_id")
        .groupBy(key)
        .agg(
            S.area_weighted_mean(None, None, "susc").alias("sup_score"),
            F.sum("overlap").alias("covered"),
            S.dominant_category("lex_d", F.round("overlap", 6), F.col("zone_id")).alias("sup_geol"),
        )
    )
    return base.join(scored, key, "left").select(
        key,
        F.coalesce("sup_score", F.lit(0.0)).alias("sup_score"),
        unit(F.coalesce("covered", F.lit(0.0)) / F.greatest("area", F.lit(1.0))).alias("sup_frac"),
        F.coalesce(R.title_case(F.col("sup_geol")), F.lit(V.NO_DRIFT)).alias("sup_geol"),
    )


def subsidence_score(
    districts: DataFrame, bedrock: DataFrame, drift: DataFrame | None, cell: float, key: str = KEY,
    susc: Column | None = None, known=V.DEPOSITS, left_out=V.DEPOSITS_LEFT_OUT,
) -> DataFrame:
    """The one subsidence surface: bedrock pulled towards drift by a bounded weight."""
    both = bedrock_score(districts, bedrock, cell, key, susc).join(
        drift_score(districts, drift, cell, key, known, left_out), key
    )
    return both.withColumn(
        "sub_score", R.blend_bounded(F.col("bed_score"), F.col("sup_score"), F.col("sup_frac"))
    )
