"""Standard normal distribution as plain Column arithmetic.

Spark has neither erf nor an inverse normal, so both directions use published
rational approximations that stay in whole-stage codegen. They work on column
names, several at a time: an argument appears many times in its polynomial, so
a nested expression would be copied into each place.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Hart (1968) / West (2005) upper tail, ascending powers.
TAIL_NUMERATOR = (
    220.206867912376, 221.213596169931, 112.079291497871, 33.912866078383,
    6.37396220353165, 0.700383064443688, 0.0352624965998911,
)
TAIL_DENOMINATOR = (
    440.413735824752, 793.826512519948, 637.333633378831, 296.564248779674,
    86.7807322029461, 16.064177579207, 1.75566716318264, 0.0883883476483184,
)
TAIL_SWITCH = 7.07106781186547
TAIL_END = 37.0
SQRT_TWO_PI = 2.506628274631

# Wichura (1988) AS 241, descending powers of each piece.
CENTRE_NUMERATOR = (
    2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4,
    4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3,
    1.3314166789178437745e2, 3.3871328727963666080e0,
)
CENTRE_DENOMINATOR = (
    5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4,
    2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2,
    4.2313330701600911252e1, 1.0,
)
MIDDLE_NUMERATOR = (
    7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1,
    1.27045825245236838258e0, 3.64784832476320460504e0, 5.76949722146069140550e0,
    4.63033784615654529590e0, 1.42343711074968357734e0,
)
MIDDLE_DENOMINATOR = (
    1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2,
    1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e0,
    2.05319162663775882187e0, 1.0,
)
FAR_NUMERATOR = (
    2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3,
    2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580e0,
    5.46378491116411436990e0, 6.65790464350110377720e0,
)
FAR_DENOMINATOR = (
    2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5,
    7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1,
    5.99832206555887937690e-1, 1.0,
)


def _num(v: float) -> str:
    return f"{v!r}D"


def _horner(x: str, descending: Sequence[float]) -> str:
    """Polynomial in ``x`` as SQL text: one parsed expression, not a call per term."""
    return reduce(lambda acc, c: f"({acc} * {x} + {_num(c)})", descending[1:], _num(descending[0]))


def _ratio(x: str, over: Sequence[float], under: Sequence[float]) -> str:
    return f"{_horner(x, over)} / {_horner(x, under)}"


def with_norm_cdf(df: DataFrame, targets: dict[str, str]) -> DataFrame:
    """Add, for each output name, P(standard normal <= input column).

    The parts that occur many times are columns of their own, so they are
    computed once per row and the expressions stay small. NULL gives NULL at
    no cost.
    """
    parts = {}
    for o, z in targets.items():
        parts[f"_a_{o}"] = F.expr(f"abs(`{z}`)")
        parts[f"_k_{o}"] = F.expr(f"exp(-`{z}` * `{z}` / 2)")
    df = df.withColumns(parts)

    def tail(o: str) -> Column:
        a, density = f"_a_{o}", f"_k_{o}"
        near = _ratio(a, TAIL_NUMERATOR[::-1], TAIL_DENOMINATOR[::-1])
        fraction = f"({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 0.65D)))))"
        return F.expr(
            f"""CASE WHEN {a} < {_num(TAIL_SWITCH)} THEN {density} * {near}
                     WHEN {a} <= {_num(TAIL_END)} THEN {density} / {fraction} / {_num(SQRT_TWO_PI)}
                     WHEN {a} IS NOT NULL THEN 0D END"""
        )

    df = df.withColumns({f"_t_{o}": tail(o) for o in targets})
    df = df.withColumns(
        {o: F.expr(f"CASE WHEN `{z}` > 0 THEN 1 - _t_{o} ELSE _t_{o} END") for o, z in targets.items()}
    )
    return df.drop(*[f"_{t}_{o}" for o in targets for t in "akt"])


def with_norm_ppf(df: DataFrame, targets: dict[str, str]) -> DataFrame:
    """Add, for each output name, the normal score of a probability column in (0, 1)."""
    parts = {}
    for o, p in targets.items():
        parts[f"_q_{o}"] = F.expr(f"`{p}` - 0.5D")
        parts[f"_r_{o}"] = F.expr(
            f"CASE WHEN abs(`{p}` - 0.5D) > 0.425D THEN sqrt(-ln(least(`{p}`, 1 - `{p}`))) END"
        )
    df = df.withColumns(parts)

    def score(o: str) -> Column:
        q, r = f"_q_{o}", f"_r_{o}"
        centre = _ratio(f"(0.180625D - {q} * {q})", CENTRE_NUMERATOR, CENTRE_DENOMINATOR)
        middle = _ratio(f"({r} - 1.6D)", MIDDLE_NUMERATOR, MIDDLE_DENOMINATOR)
        far = _ratio(f"({r} - 5D)", FAR_NUMERATOR, FAR_DENOMINATOR)
        return F.expr(
            f"""CASE WHEN {q} IS NULL THEN NULL WHEN {r} IS NULL THEN {q} * {centre}
                     WHEN {r} <= 5 THEN signum({q}) * {middle} ELSE signum({q}) * {far} END"""
        )

    df = df.withColumns({o: score(o) for o in targets})
    return df.drop(*[f"_{t}_{o}" for o in targets for t in "qr"])
