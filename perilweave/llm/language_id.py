"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilweave.session import materialize

from .batches import gather, mix64, slices, words
from .learning import Ftrl, digest_share

DIMENSIONS = 1 << 15
# All n-grams of a slice's distinct words are held at once, so slices are small.
SLICE_BYTES = 1 << 20
ORDERS = (1, 2, 3)
ROWS_PER_LANGUAGE = 1_000
MOST_LANGUAGES = 512
HELD_BACK = 0.2
UNKNOWN = "und"
# Of the rows learned from: the share that sets a bound, and how far beyond it texts still count as known.
KEPT_SHARE = 0.995
MARGIN = 1.5
LEAST_ROWS = 20


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    rarity: np.ndarray | None = None
    usual: np.ndarray | None = None
    bound: np.ndarray | None = None
    least_score: float = 0.0


def word_grams(known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram numbers, first position, count) of each word, the ends of the word being characters too.

    Letter case is folded; n-grams are hashed to DIMENSIONS numbers.
    """
    marked = [f"\x02{w}\x03" for w in pc.utf8_lower(known).to_pylist()]
    letters = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4")
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    del marked
    # A word has its n-grams of one order after the other; shorter words have none of the longer orders.
    each = np.maximum(size[:, None] - np.array(ORDERS) + 1, 0)
    counts = each.sum(axis=1)
    first = np.cumsum(counts) - counts
    begin = np.cumsum(size) - size
    keys = np.empty(int(counts.sum()), np.int32)
    for place, order in enumerate(ORDERS):
        n = each[:, place]
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(begin, n) + inside
        value = np.full(len(at), order, np.uint64)
        for k in range(order):
            value = mix64(value * np.uint64(0x100000001B3) + letters[at + k])
        keys[np.repeat(first + each[:, :place].sum(axis=1), n) + inside] = value % np.uint64(DIMENSIONS)
    return keys, first, counts


def _slices_of(batches, *carried):
    for batch in batches:
        for start, stop in slices(batch.column("text"), SLICE_BYTES):
            part = batch.slice(start, stop - start)
            yield part, *words(part.column("text"))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many rows each n-gram stands, and the number of rows; one pass over all of them."""

    def run(batches):
        total, rows = np.zeros(DIMENSIONS, np.int64), 0
        for part, offsets, codes, known in _slices_of(batches):
            grams, at, counts = word_grams(known)
            rows += len(part)
            for begin in range(0, len(part), 128):
                end = min(begin + 128, len(part))
                span = slice(offsets[begin], offsets[end])
                row = np.repeat(np.arange(end - begin), np.diff(offsets[begin : end + 1]))
                pair = np.unique(row * len(known) + codes[span])
                row, word = pair // max(len(known), 1), pair % max(len(known), 1)
                seen = np.zeros((end - begin, DIMENSIONS), bool)
                seen[np.repeat(row, counts[word]), gather(grams, at, counts, word)] = True
                total += seen.sum(axis=0)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(found, -1), pa.int32()), pa.array(np.append(total[found], rows), pa.int64())], ["gram", "n"]
        )

    found = docs.select("text").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(DIMENSIONS, np.int64)
    inside = found[found.gram >= 0]
    counts[inside.gram] = inside.n
    return counts, int(found.loc[found.gram < 0, "n"].sum())


def _vectors(sample: DataFrame) -> list[tuple[str, float, np.ndarray, np.ndarray]]:
    """(language, digest, n-gram numbers, frequencies, n-grams in all) of the sampled rows."""

    def run(batches):
        for part, offsets, codes, known in _slices_of(batches):
            grams, at, counts = word_grams(known)
            numbers, shares, sizes = [], [], []
            for i in range(len(part)):
                own = gather(grams, at, counts, codes[offsets[i] : offsets[i + 1]])
                number, n = np.unique(own, return_counts=True)
                numbers.append(number)
                sizes.append(len(own))
                shares.append((n / max(len(own), 1)).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("lang"), part.column("digest"),
                    pa.array(numbers, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32())), pa.array(sizes, pa.int64()),
                ],
                ["lang", "digest", "grams", "tf", "n"],
            )

    table = sample.select("text", "lang", "digest").mapInArrow(
        run, "lang string, digest double, grams array<int>, tf array<float>, n long"
    ).toArrow()
    rows = []
    for i in range(len(table)):
        grams, tf = (table.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("grams", "tf"))
        lang, digest, n = (table.column(c)[i].as_py() for c in ("lang", "digest", "n"))
        rows.append((lang, digest, grams, tf.astype(np.float64), n))
    return sorted(rows, key=lambda r: (r[1], r[0]))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(docs: DataFrame, epochs: int = 6) -> Model | None:
    """Fit on the rows of ``docs(doc_id, text, lang)`` whose lang and text are not null.

    Document frequencies are those of all these rows. Weights are fitted on a
    sample of about ROWS_PER_LANGUAGE rows of each language (of at most
    MOST_LANGUAGES, the commonest), drawn by a digest of doc_id, of which a
    fifth is held back to fit the temperature. None if there is nothing to learn.
    """
    rows = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    if not sizes:
        return None
    counts, total = document_frequencies(rows)
    idf = np.where(counts > 0, np.log((1 + total) / (1 + counts)) + 1, 0.0)
    languages = sorted(r["lang"] for r in sizes)
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, ROWS_PER_LANGUAGE / r["count"]))])
    drawn = digest_share(F.col("doc_id"), "language")
    sample = rows.withColumn("digest", drawn).where(F.col("digest") < share[F.col("lang")])
    # the digest spreads over [0, share): what matters is its order, made anew by a second one
    sample = sample.withColumn("digest", digest_share(F.col("doc_id"), "order"))
    examples = _vectors(sample.limit(2 * ROWS_PER_LANGUAGE * len(languages)))
    number = {x: i for i, x in enumerate(languages)}
    cut = int(len(examples) * HELD_BACK) if len(examples) >= 50 else 0
    held, used = examples[:cut], examples[cut:]
    learner, bias = Ftrl((DIMENSIONS, len(languages)), rate=2.0, l1=1e-3, l2=1e-4), Ftrl(len(languages), l1=0, l2=0)
    for _ in range(epochs):
        for lang, _, grams, tf, _ in used:
            x = tf * idf[grams]
            w, b = learner.weights(grams), bias.weights()
            error = _softmax(x @ w + b)
            error[number[lang]] -= 1
            learner.update(grams, x[:, None] * error, w)
            bias.update(slice(None), error, b)
    model = Model(languages, idf, learner.weights(), bias.weights())
    calibrated = held or used
    logits = np.array([(tf * idf[g]) @ model.weights[g] + model.bias for _, _, g, tf, _ in calibrated])
    truth = np.array([number[lang] for lang, *_ in calibrated])
    best = np.inf
    for temperature in np.geomspace(0.05, 5, 80):
        p = _softmax(logits / temperature)[np.arange(len(truth)), truth]
        loss = -np.log(np.maximum(p, 1e-12)).mean()
        if loss < best - 1e-9:
            best, model.temperature = loss, float(temperature)
    _bound(model, examples, number, counts, total)
    p = _softmax(logits / model.temperature)[np.arange(len(truth)), truth]
    even = 1 / len(languages)
    if len(p) >= LEAST_ROWS:
        model.least_score = max(0.0, even + (np.quantile(p, 1 - KEPT_SHARE, method="lower") - even) / MARGIN)
    return model


def _bound(model: Model, examples: list, number: dict[str, int], counts: np.ndarray, total: int) -> None:
    """How rare a language's n-grams usually are, and how rare they may be.

    A softmax only tells the learned languages apart. Texts in none of them show
    by n-grams that few rows hold. The examples are measured without themselves,
    and a language with fewer than LEAST_ROWS of them rejects nothing.
    """
    model.rarity = np.log((1 + total) / (1 + counts))
    without = np.log((1 + total) / np.maximum(counts, 1))
    model.usual, model.bound = np.zeros(len(number)), np.full(len(number), np.inf)
    mean, size, lang = (np.array(x) for x in zip(*[(tf @ without[g], n, number[k]) for k, _, g, tf, n in examples if n])) if any(
        e[4] for e in examples
    ) else (np.zeros(0),) * 3
    for k in range(len(number)):
        own = lang == k
        if own.sum() >= LEAST_ROWS:
            model.usual[k] = np.median(mean[own])
            strange = _strangeness(mean[own], model.usual[k], size[own])
            model.bound[k] = MARGIN * np.quantile(strange, KEPT_SHARE, method="higher")


def _strangeness(rarity, usual, n):
    """Mean rarity beyond the usual, weighed up the more n-grams there are."""
    return (rarity - usual) * np.sqrt(n / (n + 20.0))


def language_column(model: Model | None, text: str = "text") -> Column:
    """struct(lang_pred, score, known) of a text; ``und`` with score 0 if it is null or has no letter.

    ``known`` says whether the text can be in a learned language at all.
    """
    if model is None:
        return F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("known"))
    table = model.idf[:, None] * model.weights
    table = np.concatenate([table, model.rarity[:, None]], axis=1)
    bias, names, temperature = model.bias, pa.array(model.languages), model.temperature
    usual, bound, least_score = model.usual, model.bound, model.least_score

    @F.arrow_udf("struct<lang_pred string, score double, known boolean>")
    def predict(texts: pa.Array) -> pa.Array:
        langs, scores, knowns = [], [], []
        for start, stop in slices(texts, SLICE_BYTES):
            offsets, codes, known = words(texts.slice(start, stop - start))
            grams, at, counts = word_grams(known)
            n = np.add.reduceat(np.append(counts[codes], 0), offsets[:-1]) if len(codes) else np.zeros(len(offsets) - 1)
            n = np.where(np.diff(offsets) > 0, n, 0)
            logits = np.zeros((len(offsets) - 1, len(names) + 1))
            for k in range(len(names) + 1):
                # TF-IDF is linear in the counts, so a word's share of the score is the same wherever it stands
                by_word = np.add.reduceat(table[grams, k], at) if len(grams) else np.zeros(0)
                total = np.concatenate([[0.0], np.cumsum(by_word[codes])]) if len(codes) else np.zeros(1)
                logits[:, k] = (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(n, 1)
            logits, rarity = logits[:, :-1], logits[:, -1]
            p = _softmax((logits + bias) / temperature)
            best = p.argmax(axis=1)
            langs.append(names.take(pa.array(best)))
            scores.append(p[np.arange(len(best)), best])
            knowns.append((_strangeness(rarity, usual[best], n) <= bound[best]) & (scores[-1] >= least_score))
        langs = pa.concat_arrays(langs) if langs else pa.array([], pa.string())
        return pa.StructArray.from_arrays(
            [langs, *(pa.array(np.concatenate(x) if x else np.zeros(0, t)) for x, t in ((scores, float), (knowns, bool)))],
            ["lang_pred", "score", "known"],
        )

    lettered = F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False))
    found = predict(F.coalesce(F.col(text), F.lit("")))
    return F.struct(
        F.when(lettered, found["lang_pred"]).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(lettered, found["score"]).otherwise(0.0).alias("score"),
        F.when(lettered, found["known"]).otherwise(False).alias("known"),
    )


def held_out(key: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; never so for a null id."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs(doc_id, text, lang)``.

    The model learns from the rows that are not held out. A null text, or one
    without a letter, is ``und`` with score 0; so is every text if there is no
    row to learn from. Repeated rows get equal answers; a null doc_id is not
    held out; other columns are ignored; an empty table gives no rows.
    """
    model = train(docs.where(~held_out()))
    found = docs.select("doc_id", held_out().alias("held_out"), language_column(model).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")
