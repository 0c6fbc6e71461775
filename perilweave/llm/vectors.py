"""Helpers for tables of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Whether a vector is neither null nor zero and holds only finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(
        ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False)
    )


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long lists as a matrix of doubles."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def sample(vectors: DataFrame, vector: str, size: int, key: str) -> np.ndarray:
    """About ``size`` usable vectors, never more than twice that, chosen by a digest of the key."""
    rows = vectors.where(usable(vector))
    total = rows.count()
    if not total:
        return np.zeros((0, 0))
    share = min(1.0, size / total)
    drawn = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1
    found = rows.where(drawn).select(vector).limit(2 * size).toArrow()
    x = matrix(found.column(0).combine_chunks())
    return x[np.lexsort(x.T)]


def spherical_kmeans(x: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centroids of the directions of the rows of ``x``."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    pick = np.random.default_rng(seed).choice(len(unit), min(cells, len(unit)), replace=False)
    centres = unit[np.sort(pick)]
    for _ in range(rounds):
        near = (unit @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, unit)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), centres)
    return np.unique(centres, axis=0)


def kmeans(x: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centroids of the rows of ``x`` by squared distance."""
    pick = np.random.default_rng(seed).choice(len(x), min(cells, len(x)), replace=False)
    centres = x[np.sort(pick)]
    for _ in range(rounds):
        near = (x @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
        sums, n = np.zeros_like(centres), np.bincount(near, minlength=len(centres))[:, None]
        np.add.at(sums, near, x)
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return np.unique(centres, axis=0)
