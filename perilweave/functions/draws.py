"""Reproducible uniform draws keyed by value, not by position.

A draw depends only on its key, so it is the same on every partitioning,
cluster size and retry.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEX_13 = float(16**13)
_HEX_8 = float(16**8)


def _key(*parts: Column | int | str) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws("|", *[c.cast("string") for c in cols])


def uniform(*parts: Column | int | str) -> Column:
    """One draw in (0, 1) with 52 bits, from the digest of the joined key."""
    digits = F.conv(F.substring(F.md5(_key(*parts)), 1, 13), 16, 10).cast("double")
    return (digits + F.lit(0.5)) / F.lit(_HEX_13)


def digest(*parts: Column | int | str) -> Column:
    """Digest to be cut into several draws with :func:`uniform_slice`."""
    return F.md5(_key(*parts))


def uniform_slice(digest_col: Column, index: int) -> Column:
    """Draw ``index`` (0 to 3) of a digest: 32 bits each, independent of each other."""
    digits = F.conv(F.substring(digest_col, 1 + 8 * index, 8), 16, 10).cast("double")
    return (digits + F.lit(0.5)) / F.lit(_HEX_8)
