"""Oracle text of the normal distribution; arguments are column names."""

from __future__ import annotations

from ..functions import normal as N


def _poly(x: str, descending) -> str:
    out = f"{descending[0]:.20e}"
    for c in descending[1:]:
        out = f"({out} * {x} + {c:.20e})"
    return out


def cdf(z: str) -> str:
    a = f"abs({z})"
    rational = f"exp(-{z} * {z} / 2) * {_poly(a, N.TAIL_NUMERATOR[::-1])} / {_poly(a, N.TAIL_DENOMINATOR[::-1])}"
    fraction = f"({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 65e-2)))))"
    tail = (
        f"CASE WHEN {a} < {N.TAIL_SWITCH!r} THEN {rational} WHEN {a} <= 37 THEN "
        f"exp(-{z} * {z} / 2) / {fraction} / {N.SQRT_TWO_PI!r} ELSE 0e0 END"
    )
    return f"CASE WHEN {z} > 0 THEN 1 - ({tail}) ELSE {tail} END"


def ppf(p: str) -> str:
    q = f"({p} - 5e-1)"
    c = f"(180625e-6 - {q} * {q})"
    r = f"sqrt(-ln(least({p}, 1 - {p})))"
    near, far = f"({r} - 16e-1)", f"({r} - 5)"
    return f"""CASE WHEN abs({q}) <= 425e-3 THEN {q} * {_poly(c, N.CENTRE_NUMERATOR)} / {_poly(c, N.CENTRE_DENOMINATOR)}
      WHEN {r} <= 5 THEN sign({q}) * {_poly(near, N.MIDDLE_NUMERATOR)} / {_poly(near, N.MIDDLE_DENOMINATOR)}
      ELSE sign({q}) * {_poly(far, N.FAR_NUMERATOR)} / {_poly(far, N.FAR_DENOMINATOR)} END"""


def uniform(*parts: str) -> str:
    """Draw in (0, 1) from the digest of the joined parts (SQL expressions)."""
    key = " || '|' || ".join(p if p.startswith("'") else f"CAST({p} AS VARCHAR)" for p in parts)
    return f"((('0x' || substr(md5({key}), 1, 13))::BIGINT + 5e-1) / pow(16e0, 13))"


PARAMS = """pm AS (SELECT p.*, p_sub * k_sub AS q_sub, p_wx * k_wx AS q_wx, (p_river + p_surface) * k_fl AS q_fl, p_gw * k_gw AS q_gw, p_er AS q_er,
      ln(17820e0) - 81e-2 / 2 AS mu_sub, ln(2450e0) - 121e-2 / 2 AS mu_wx,
      (p_river * (ln(35e3) - 81e-2 / 2) + p_surface * (ln(18e3 * sw_sev) - 81e-2 / 2)) / (p_river + p_surface) AS mu_fl,
      ln(2e4) - 64e-2 / 2 AS mu_gw, ln(25e4) - 1225e-4 / 2 AS mu_er,
      least(125e-2 + 125e-2 * sqrt(wx_score * sub_score), 25e-1) AS th_sub, least(14e-1 + 16e-1 * sqrt(wx_score * fl_score), 3e0) AS th_fl,
      least(13e-1 + 11e-1 * sqrt(wx_score * gw_score), 24e-1) AS th_gw, least(135e-2 + 13e-1 * sqrt(wx_score * er_score), 26e-1) AS th_er
    FROM p CROSS JOIN m)"""
