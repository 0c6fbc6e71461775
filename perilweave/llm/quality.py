"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilweave.session import materialize

from .batches import mix64, row_sums, slices, word_hashes, words
from .learning import digest_share, labelled_sample, tokens

BUCKETS = 1 << 14
LABELLED_ROWS = 8_000
SMOOTHING = 0.5
LEAST_CHANCE = 0.05
HELD_BACK = 0.2
KEPT_CLEAN = 0.998
HISTOGRAM = 4096
REPEATED = np.uint64(0)


@dataclass
class Model:
    """log p(target) - log p(raw) of each bucket, the calibration of a text's ratio, and the log odds from which a row counts as target text."""

    ratio: np.ndarray
    slope: float = 1.0
    spread: float = 0.0
    base: float = 0.0
    least: float = 0.0


def n_gram_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every one- and two-token sequence, row offsets), tokens being words or runs of signs.

    A token that follows itself is one and the same sequence whatever the token,
    so that repetition is learned from any words and known with all.
    """
    offsets, codes, known = words(tokens(texts))
    hashed = mix64(word_hashes(known))[codes] if len(codes) else np.zeros(0, np.uint64)
    size = np.diff(offsets)
    follows = np.ones(len(hashed), bool)
    follows[offsets[1:][size > 0] - 1] = False
    pairs = mix64(hashed[:-1] * np.uint64(3) + hashed[1:]) if len(hashed) else hashed
    pairs = np.where(hashed[:-1] == hashed[1:], REPEATED, pairs)[follows[:-1]] if len(hashed) else hashed
    row = np.repeat(np.arange(len(size)), size)
    both = np.concatenate([hashed, pairs])
    rows = np.concatenate([row, row[:-1][follows[:-1]] if len(row) else row])
    order = np.argsort(rows, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(size)))])
    return (both % np.uint64(BUCKETS)).astype(np.int64)[order], ends


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit the two generative models, the calibration and the least log odds.

    The raw model counts the n-grams of every row of ``docs(doc_id, text)``, the
    target model those of the sampled rows labelled 1 in ``labels(doc_id,
    quality)``. At most twice LABELLED_ROWS rows are sampled, a bound that makes
    the broadcast safe. None if one of the classes is missing.

    HELD_BACK of the sample takes no part in models and calibration, if 50 rows
    are labelled 1; the least log odds are set on these rows, otherwise on all.
    """
    drawn = materialize(labelled_sample(labels, "quality", LABELLED_ROWS, "quality"), "labelled")
    share = HELD_BACK if drawn.where("label = 1").count() >= 50 else 0.0
    drawn = drawn.withColumn("held", digest_share(F.col("doc_id"), "held back") < share)
    marked = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id", "left")
    marked = marked.select(F.when(~F.col("held"), F.col("label")).alias("label"), "text")

    def run(batches):
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            good = batch.column("label").fill_null(0).to_numpy(zero_copy_only=False) == 1
            for start, stop in slices(batch.column("text")):
                buckets, offsets = n_gram_buckets(batch.column("text").slice(start, stop - start))
                counts[0] += np.bincount(buckets, minlength=BUCKETS)
                chosen = np.repeat(good[start:stop], np.diff(offsets))
                counts[1] += np.bincount(buckets[chosen], minlength=BUCKETS)
        found = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(found, pa.int32()), pa.array(counts[0, found]), pa.array(counts[1, found])], ["bucket", "raw", "target"]
        )

    counted = marked.mapInArrow(run, "bucket int, raw long, target long")
    counted = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.full(BUCKETS, SMOOTHING), np.full(BUCKETS, SMOOTHING)
    raw[counted.bucket] += counted.raw
    target[counted.bucket] += counted.target
    if not counted.target.sum():
        return None
    model = Model(np.log(target / target.sum()) - np.log(raw / raw.sum()))
    known = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    seen = known.select("label", "held", ratio_column(model).alias("r")).where("r.n > 0")
    seen = seen.select("label", "held", "r.log_ratio", "r.n").toPandas()
    if seen.label.nunique() < 2:
        return None
    used = seen[~seen.held]
    model = _calibrated(model, used if used.label.nunique() > 1 else seen)
    held = seen[seen.held & (seen.label == 1)]
    model.least = _least_odds(model, held if len(held) else seen[seen.label == 1])
    return model


def _least_odds(model: Model, clean) -> float:
    """The highest log odds that KEPT_CLEAN of the clean rows reach, between LEAST_CHANCE and even odds.

    Beyond even odds a threshold would drop texts that the model holds to be clean.
    """
    n = clean.n.to_numpy(np.float64)
    odds = model.slope * _features(model, clean.log_ratio.to_numpy(), n) + model.base
    return float(np.clip(np.quantile(odds, 1 - KEPT_CLEAN, method="lower"), _log_odds(LEAST_CHANCE), 0.0))


def _log_odds(chance: float) -> float:
    return float(np.log(chance / (1 - chance)))


def _features(model: Model, ratio, n, sqrt=np.sqrt):
    """A text's log ratio by n-gram, weighed up the more of them there are."""
    return ratio / n * sqrt(n / (n + 20.0))


def _calibrated(model: Model, seen) -> Model:
    """Logistic calibration of the mean log ratio, by Newton's method."""
    n = seen.n.to_numpy(np.float64)
    x = np.stack([_features(model, seen.log_ratio.to_numpy(), n) * 10, np.ones(len(seen))], axis=1)
    y, w = (seen.label == 1).to_numpy(np.float64), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + 0.1 * w * [1, 0]
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag([0.1, 1e-6])
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    model.slope, model.base = float(w[0]) * 10, float(w[1])
    return model


def ratio_column(model: Model, text: str = "text") -> Column:
    """struct(n, log_ratio) of a text: its n-grams and the sum of their log ratios."""
    ratio = model.ratio

    @F.arrow_udf("struct<n bigint, log_ratio double>")
    def measure(texts: pa.Array) -> pa.Array:
        sizes, sums = [np.zeros(0, np.int64)], [np.zeros(0)]
        for start, stop in slices(texts):
            buckets, offsets = n_gram_buckets(texts.slice(start, stop - start))
            sizes.append(np.diff(offsets))
            sums.append(row_sums(ratio[buckets], offsets))
        return pa.StructArray.from_arrays(
            [pa.array(np.concatenate(sizes), pa.int64()), pa.array(np.concatenate(sums))], ["n", "log_ratio"]
        )

    return measure(F.coalesce(F.col(text), F.lit("")))


def _weights(model: Model | None) -> dict[str, Column]:
    """n, log_ratio, log_odds (of being target-like) and key (log odds plus Gumbel noise) of a row."""
    # Uniform noise from a digest of the row, so that reruns draw the same.
    noise = (digest_share(F.coalesce("doc_id", F.lit(0)), "gumbel") + digest_share(F.xxhash64("text"), "gumbel")) % 1.0
    gumbel = -F.log(-F.log(F.least(F.greatest(noise, F.lit(1e-12)), F.lit(1 - 1e-12))))
    if model is None:
        return {"n": F.lit(0).cast("long"), "log_ratio": F.lit(0.0), "log_odds": F.lit(0.0), "key": gumbel}
    found = ratio_column(model)
    n, ratio = found["n"], found["log_ratio"]
    odds = model.slope * _features(model, ratio, n.cast("double"), F.sqrt) + model.base
    # without any n-gram there is nothing that speaks for a text
    odds = F.when(n > 0, odds).otherwise(-100.0)
    return {"n": n, "log_ratio": ratio, "log_odds": odds, "key": odds + gumbel}


def _edge(keys: DataFrame, model: Model | None, least_chance: float | None) -> float:
    """The smallest key that Gumbel top-k selects among ``keys(log_odds, key)``."""
    least = _log_odds(least_chance) if least_chance is not None else model.least if model else 0.0
    k = keys.where(F.col("log_odds") >= least).count()
    return top_k_edge(keys.select("key"), k)


def top_k_edge(keys: DataFrame, k: int) -> float:
    """The k-th largest key of ``keys(key)``; counts in ever narrower bins, no sort and no row at the driver."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    if low is None or k <= 0:
        return float("inf")
    left = k
    while high > low:
        width = (high - low) / HISTOGRAM
        if width <= 0 or low + width == low:
            break
        bin_no = F.least(F.floor((F.col("key") - low) / width), F.lit(HISTOGRAM - 1))
        inside = keys.where((F.col("key") >= low) & (F.col("key") <= high))
        bins = inside.groupBy(bin_no.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        for row in sorted(bins.collect(), key=lambda r: -r.b):  # HISTOGRAM rows at most
            if row.n >= left:
                low, high = row.lo, row.hi
                break
            left -= row.n
        else:
            break
    return low


def select(docs: DataFrame, labels: DataFrame, least_chance: float | None = None) -> DataFrame:
    """Every row of ``docs(doc_id, text)`` with its weight, sampling key and whether it is selected.

    Columns: doc_id, n (n-grams), log_ratio, log_odds, key, selected. Gumbel
    top-k draws without replacement in proportion to the odds; k is the number
    of rows whose calibrated chance of being target text is at least
    ``least_chance`` (without it, what held-back labelled rows give), so clear
    cases on either side stay where they are and only rows near the edge are
    left to the draw. Null, empty and blank texts have
    the least odds. Equal rows have equal keys, and all rows at the edge are
    selected. If nothing can be learned every row has even odds and all are
    selected; other columns are ignored; an empty table gives no rows.
    """
    model = fit(docs, labels)
    weights = _weights(model)
    rows = docs.select("doc_id", *[c.alias(name) for name, c in weights.items()])
    rows = materialize(rows, "weighed")
    return rows.withColumn("selected", F.col("key") >= _edge(rows, model, least_chance))


def selected_rows(docs: DataFrame, labels: DataFrame, least_chance: float | None = None) -> DataFrame:
    """The rows that ``select`` selects, with the columns of ``docs``.

    The weight is computed again for the filter, so no text is written or shuffled.
    """
    model = fit(docs, labels)
    weights = _weights(model)
    keys = materialize(docs.select(weights["log_odds"].alias("log_odds"), weights["key"].alias("key")), "keys")
    return docs.where(weights["key"] >= _edge(keys, model, least_chance))
