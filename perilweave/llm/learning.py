"""Shared parts of the classifiers: sampling, counting passes and the FTRL update."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens(texts: pa.Array) -> pa.Array:
    """Texts in lower case with every run of signs set apart by spaces."""
    texts = pc.utf8_lower(pc.fill_null(texts, ""))
    return pc.replace_substring_regex(texts, r"([^\p{L}\p{M}\p{N}_\s]+)", r" \1 ")


def digest_share(key: Column, salt: str) -> Column:
    """A number in [0, 1) that depends on the key only."""
    return F.pmod(F.xxhash64(key.cast("string"), F.lit(salt)), F.lit(1 << 40)) / float(1 << 40)


def labelled_sample(labels: DataFrame, column: str, size: int, salt: str) -> DataFrame:
    """doc_id and label of about ``size`` labelled documents, at most twice that.

    Documents are drawn by a digest of doc_id, so every run draws the same. A
    document with several labels has the largest.
    """
    known = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    total = known.count()
    share = min(1.0, size / total) if total else 1.0
    return known.where(digest_share(F.col("doc_id"), salt) < share).limit(2 * size)


class Ftrl:
    """Follow the regularised leader, proximal form, with elastic-net penalties."""

    def __init__(self, shape, rate: float = 0.5, smooth: float = 1.0, l1: float = 1e-3, l2: float = 1e-3):
        self.rate, self.smooth, self.l1, self.l2 = rate, smooth, l1, l2
        self.z, self.n = np.zeros(shape), np.zeros(shape)

    def weights(self, rows=slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        step = (self.smooth + np.sqrt(n)) / self.rate + self.l2
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / step)

    def update(self, rows, gradient: np.ndarray, weights: np.ndarray) -> None:
        """One gradient on the given rows; ``weights`` are those it was taken at."""
        n = self.n[rows]
        grown = n + gradient**2
        self.z[rows] += gradient - (np.sqrt(grown) - np.sqrt(n)) / self.rate * weights
        self.n[rows] = grown
