"""Classification and filter rules as Column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocabulary as V


def classify_keywords(
    name: Column,
    rock: Column,
    period: Column,
    names: Iterable[tuple[str, float]] = V.FORMATIONS,
    rocks: Iterable[tuple[str, float]] = V.ROCK_TYPES,
    young: Iterable[str] = V.YOUNG_PERIODS,
) -> Column:
    """First keyword found in the name, then in the rock type; else a low default."""
    name, rock = F.upper(F.coalesce(name, F.lit(""))), F.upper(F.coalesce(rock, F.lit("")))
    recent = F.upper(F.trim(F.coalesce(period, F.lit("")))).isin(*young)
    aged = F.when(recent, F.lit(1.0)).otherwise(F.lit(V.OLD_ROCK_FACTOR))
    rules = [(name.contains(k), F.lit(v)) for k, v in names]
    rules += [(rock.contains(k), F.lit(v) * aged) for k, v in rocks]
    first = F.when(*rules[0])
    return reduce(lambda acc, rule: acc.when(*rule), rules[1:], first).otherwise(F.lit(V.OTHER_ROCK))


def classify_closed(
    df: DataFrame,
    term: str,
    known: Mapping[str, float] = V.DEPOSITS,
    left_out: Iterable[str] = V.DEPOSITS_LEFT_OUT,
    out: str = "susc",
) -> DataFrame:
    """Score a closed vocabulary; blank and left-out terms drop, unknown terms fail the job."""
    clean = F.upper(F.trim(F.coalesce(F.col(term), F.lit(""))))
    score = F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), clean)
    unknown = F.raise_error(F.concat(F.lit("unclassified term: "), clean)).cast("double")
    return df.where((clean != "") & ~clean.isin(*left_out)).withColumn(out, F.coalesce(score, unknown))


def terms_outside(df: DataFrame, term: str, known: Iterable[str]) -> DataFrame:
    """Distinct terms a closed vocabulary does not hold."""
    clean = F.upper(F.trim(F.col(term)))
    return df.select(clean.alias(term)).where((clean != "") & ~clean.isin(*known)).distinct()


def blend_bounded(base: Column, modifier: Column, cover: Column, weight: float = V.DRIFT_WEIGHT) -> Column:
    """Pull ``base`` towards ``modifier`` by at most ``weight`` at full cover."""
    k = weight * F.least(F.greatest(cover, F.lit(0.0)), F.lit(1.0))
    return F.least(F.greatest((1 - k) * base + k * modifier, F.lit(0.0)), F.lit(1.0))


def outward_code(postcode: Column) -> Column:
    """Part of a postcode before the space, or all but its last three characters."""
    code = F.trim(postcode)
    spaced = F.split(code, " ")[0]
    tight = F.trim(F.substring(code, F.lit(1), F.greatest(F.length(code) - 3, F.lit(0))))
    return F.upper(F.when(code.contains(" "), spaced).otherwise(tight))


def has_code_prefix(code: Column, prefixes: Iterable[str]) -> Column:
    """Keep non-blank codes that start with one of the given letters."""
    return (F.trim(code) != "") & F.substring(F.trim(code), 1, 1).isin(*prefixes)


def coverage_mask(country: Column, share: Column, wanted: str = "England", least_share: float = 0.95) -> Column:
    """Inside the mapped country for a sufficient share; unknown counts as outside."""
    return F.coalesce((country == wanted) & (share >= least_share), F.lit(False))


def enforce_nesting(df: DataFrame, outer_to_inner: Iterable[tuple[str, str]]) -> DataFrame:
    """Each outer band is at least its inner band; apply innermost pairs first, then clip."""
    touched = []
    for outer, inner in outer_to_inner:
        df = df.withColumn(outer, F.greatest(outer, inner))
        touched += [outer, inner]
    clip = lambda c: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0))
    return df.withColumns({c: clip(c) for c in dict.fromkeys(touched)})


def in_risk_band(risk: str, bands: Iterable[str] = ("High", "Medium")) -> Column:
    return F.col(risk).isin(*bands)


def detect_lonlat(x: str) -> Column:
    """Aggregate: do the magnitudes look like degrees rather than metres?"""
    return F.max(F.abs(F.col(x))) <= 180


def exposure_state(country: Column, unmanaged: Column, planned: Column, wanted: str = "England") -> Column:
    """Four states that must not be confused: not mapped, none, defended, eroding."""
    return (
        F.when(F.coalesce(country, F.lit("")) != wanted, "not mapped")
        .when(F.coalesce(planned, F.lit(0.0)) > 0, "eroding")
        .when(F.coalesce(unmanaged, F.lit(0.0)) > 0, "defended")
        .otherwise("measured zero")
    )


def title_case(text: Column) -> Column:
    """Capital after every non-letter, as in "Clay-With-Flints"."""
    marked = F.initcap(F.regexp_replace(F.lower(text), "([^a-z])(?=[a-z])", "$1 \u0001 "))
    return F.regexp_replace(marked, " \u0001 ", "")
