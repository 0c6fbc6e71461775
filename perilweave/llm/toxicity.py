"""Toxicity: cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilweave.session import materialize

from .batches import gather, slices, word_hashes, words
from .learning import Ftrl, labelled_sample, tokens

LABELLED_ROWS = 6_000
LEAST_DOCUMENTS = 5
PREFIXES = (4, 5, 6, 7)
HELD_BACK = 0.2
SEVERE_SHARE = 0.5


@dataclass
class Model:
    """Weights of token digests (sorted), and one threshold between each two grades."""

    digests: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray


def _tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row offsets, token codes, feature digests, their first position and count for each token).

    The features of a token are itself and its PREFIXES, by 64-bit digest.
    """
    offsets, codes, known = words(tokens(texts))
    features = [[t, *("<" + t[:k] for k in PREFIXES if k <= len(t))] for t in known.to_pylist()]
    counts = np.fromiter(map(len, features), np.int64, len(features))
    digests = word_hashes(pa.array([f for own in features for f in own], pa.string()))
    return offsets, codes, digests, np.cumsum(counts) - counts, counts


def _bags(sample: DataFrame) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(label, distinct token digests, their counts) of the sampled rows, in the order of a digest."""

    def run(batches):
        for batch in batches:
            for start, stop in slices(batch.column("text")):
                part = batch.slice(start, stop - start)
                offsets, codes, digests, at, n = _tokens_of(part.column("text"))
                found = [
                    np.unique(gather(digests, at, n, codes[a:b]), return_counts=True)
                    for a, b in zip(offsets[:-1], offsets[1:])
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("label"), part.column("place"),
                        pa.array([x.view(np.int64) for x, _ in found], pa.list_(pa.int64())),
                        pa.array([np.minimum(n, 1000).astype(np.int16) for _, n in found], pa.list_(pa.int16())),
                    ],
                    ["label", "place", "tokens", "counts"],
                )

    table = sample.mapInArrow(run, "label int, place long, tokens array<long>, counts array<short>").toArrow()
    rows = []
    for i in range(len(table)):
        bag, counts = (table.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("tokens", "counts"))
        rows.append((table.column("place")[i].as_py(), table.column("label")[i].as_py(), bag.view(np.uint64), counts))
    rows.sort(key=lambda r: (r[0], r[1]))
    return [(label, bag, counts) for _, label, bag, counts in rows]


def _grades(rows: list, marked: np.ndarray) -> np.ndarray:
    """Grades 0, 1, 2 from labels 0 and 1.

    Labelled texts are mild or severe by how often the tokens that mark toxic
    texts occur in them; SEVERE_SHARE of those with any are severe.
    """
    grades = np.array([int(label == 1) for label, _, _ in rows])
    hits = np.array([counts[np.isin(bag, marked)].sum() for _, bag, counts in rows])
    toxic = (grades == 1) & (hits > 0)
    if toxic.sum() >= 10:
        edge = np.quantile(hits[toxic], 1 - SEVERE_SHARE)
        grades[toxic & (hits > edge)] = 2
    return grades


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def train(docs: DataFrame, labels: DataFrame, epochs: int = 8) -> Model | None:
    """Fit on a sample of about LABELLED_ROWS labelled rows (at most twice as many).

    Features are the distinct tokens and word beginnings that stand in LEAST_DOCUMENTS sampled texts
    or more, by 64-bit digest, so rare ones share no weight with common ones.
    With the probability of a grade above j as the logistic of score minus
    threshold j, one weight vector serves all thresholds; FTRL with elastic-net
    penalties keeps it sparse. A fifth of the sample is held back and sets the
    first threshold, where clean and toxic texts part best. None without both
    labels.
    """
    drawn = labelled_sample(labels, "toxic", LABELLED_ROWS, "toxicity")
    sample = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    sample = sample.select("label", F.xxhash64("doc_id", F.lit("order")).alias("place"), "text")
    rows = _bags(sample.limit(4 * LABELLED_ROWS))
    if len({int(label == 1) for label, _, _ in rows}) < 2:
        return None
    every, documents = np.unique(np.concatenate([bag for _, bag, _ in rows]), return_counts=True)
    vocabulary = every[documents >= LEAST_DOCUMENTS]
    at = []
    for _, bag, _ in rows:
        place = np.searchsorted(vocabulary, bag)
        inside = place < len(vocabulary)
        inside[inside] = vocabulary[place[inside]] == bag[inside]
        at.append(place[inside])
    toxic = np.array([label == 1 for label, _, _ in rows])
    seen = [np.zeros(len(vocabulary)) for _ in range(2)]
    for x, t in zip(at, toxic):
        seen[int(t)][x] += 1
    odds = np.log((seen[1] + 0.5) / (toxic.sum() + 1)) - np.log((seen[0] + 0.5) / ((~toxic).sum() + 1))
    grades = _grades(rows, vocabulary[(odds > 3) & (seen[1] >= LEAST_DOCUMENTS)])
    top = int(grades.max())
    cut = int(len(rows) * HELD_BACK) if len(rows) >= 50 else 0
    learner = Ftrl(len(vocabulary), rate=0.3, l1=8.0, l2=0.1)
    # Thresholds as a first one and positive steps, so that they stay in order.
    levels = np.array([2.0, *np.ones(top - 1)])
    for epoch in range(epochs):
        for x, grade in zip(at[cut:], grades[cut:]):
            w = learner.weights(x)
            above = _sigmoid(w.sum() - np.cumsum(levels))
            edges = np.concatenate([[1.0], above, [0.0]])
            chance = max(edges[grade] - edges[grade + 1], 1e-9)
            slope = above * (1 - above)
            slopes = np.concatenate([[0.0], slope, [0.0]])
            by_score = -(slopes[grade] - slopes[grade + 1]) / chance
            learner.update(x, np.full(len(x), by_score), w)
            by_edge = np.zeros(top)
            if grade:
                by_edge[grade - 1] += slope[grade - 1] / chance
            if grade < top:
                by_edge[grade] -= slope[grade] / chance
            step = np.cumsum(by_edge[::-1])[::-1]
            levels -= 0.05 / (1 + epoch) * np.clip(step, -5, 5)
            levels[1:] = np.maximum(levels[1:], 0.1)
    weights = learner.weights()
    thresholds = np.cumsum(levels)
    used = weights != 0
    model = Model(vocabulary[used], weights[used], thresholds)
    checked = range(cut) if cut else range(len(rows))
    scores = np.array([weights[at[i]].sum() for i in checked])
    truth = toxic[list(checked)]
    if truth.any() and not truth.all():
        tried = np.unique(np.concatenate([scores, [thresholds[0]]]))
        middles = (tried[1:] + tried[:-1]) / 2
        wrong = [((scores > m) != truth).sum() for m in middles]
        best = [m for m, e in zip(middles, wrong) if e == min(wrong)] if len(middles) else [thresholds[0]]
        model.thresholds = thresholds + (best[len(best) // 2] - thresholds[0])
    return model


def severity_column(model: Model | None, text: str = "text") -> Column:
    """struct(severity, grade, p_toxic) of a text."""
    kind = "struct<severity double, grade int, p_toxic double>"
    if model is None:
        return F.lit(None).cast(kind)

    @F.arrow_udf(kind)
    def measure(texts: pa.Array) -> pa.Array:
        scores, filled = [np.zeros(0)], [np.zeros(0, bool)]
        for start, stop in slices(texts):
            offsets, codes, digests, at, n = _tokens_of(texts.slice(start, stop - start))
            size, known = np.diff(offsets), max(len(model.digests), 1)
            place = np.minimum(np.searchsorted(model.digests, digests), known - 1)
            weighs = model.digests[place] == digests if len(model.digests) else np.zeros(len(digests), bool)
            # only tokens with a weighing feature are looked at again
            hit = np.flatnonzero(np.add.reduceat(weighs.astype(int), at)[codes]) if len(codes) else codes
            row = np.repeat(np.searchsorted(offsets, hit, "right") - 1, n[codes[hit]])
            pick = gather(np.arange(len(digests)), at, n, codes[hit])
            row, pick = row[weighs[pick]], place[pick[weighs[pick]]]
            # a feature counts once in a text
            pair = np.unique(row * known + pick)
            scores.append(np.bincount(pair // known, model.weights[pair % known], minlength=len(size)) if len(pair) else np.zeros(len(size)))
            filled.append(size > 0)
        scores, filled = np.concatenate(scores), np.concatenate(filled)
        above = _sigmoid(scores[:, None] - model.thresholds[None]) * filled[:, None]
        edges = np.concatenate([np.ones((len(scores), 1)), above, np.zeros((len(scores), 1))], axis=1)
        return pa.StructArray.from_arrays(
            [
                pa.array(above.sum(axis=1)),
                pa.array((edges[:, :-1] - edges[:, 1:]).argmax(axis=1), pa.int32()),
                pa.array(above[:, 0]),
            ],
            ["severity", "grade", "p_toxic"],
        )

    return measure(F.coalesce(F.col(text), F.lit("")))


def grade(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, severity (expected grade, 0 to 2), grade, p_toxic, toxic of every row of ``docs(doc_id, text)``.

    ``labels(doc_id, toxic)`` is what is learned from. A text without words has
    severity 0 and is not toxic. Without labels of both kinds severity, grade
    and p_toxic are null and nothing is toxic. Repeated rows get equal answers;
    other columns are ignored; an empty table gives no rows.
    """
    model = train(docs, labels)
    found = docs.select("doc_id", severity_column(model).alias("found")).select("doc_id", "found.*")
    return found.withColumn("toxic", F.coalesce(F.col("p_toxic") >= 0.5, F.lit(False)))
