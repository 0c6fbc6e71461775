"""Classifiers on small synthetic texts: accuracy on rows they did not learn from, and odd rows."""

import zlib

import numpy as np
import pytest

from perilweave.llm import language_id, quality, toxicity

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "ver", "ent"], "cc": ["é", "oux", "que", "ai"]}


def text_of(draw, lang, words):
    return " ".join("".join(draw.choice(SYLLABLES[lang], draw.integers(1, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def corpus(spark):
    draw = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(600):
        lang = ("aa", "bb", "cc")[i % 3]
        text, good, toxic = text_of(draw, lang, int(draw.integers(3, 60))), i % 5 != 0, i % 4 == 1
        if not good:
            text = " ".join(w + "&&& ###" for w in text.split())
        if toxic:
            words = text.split()
            for _ in range(draw.integers(1, 5)):
                words.insert(draw.integers(0, len(words)), draw.choice(["nasty", "vileness", "vilest"]))
            text = " ".join(words)
        rows.append((i, text, lang if i % 50 else None, "x"))
        if i % 2:
            labels.append((i, int(good), int(toxic)))
    rows += [(600, None, "aa", "x"), (601, "", "aa", "x"), (602, "12 34 !!", None, "x"), (None, "kalo", "aa", "x")]
    rows += [(603, "kalo tuka " * 30_000, "aa", "x")] + [rows[7]] * 2
    labels += [(5, None, None), (None, 1, 1), (10_000, 1, 0), (7, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(4)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def test_language_of_held_out_rows(spark, corpus):
    docs, _, rows = corpus
    got = language_id.identify(docs).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    lang = {r[0]: r[2] for r in rows}
    for i in (600, 601, 602):
        assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0.0)
    assert not by_id[None].held_out
    held = [r for r in got if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if r.held_out}
    known = [r for r in held if lang[r.doc_id] and r.lang_pred != "und"]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in known]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    alone = language_id.identify(docs.where("lang is null")).collect()
    assert {(r.lang_pred, r.score) for r in alone} == {("und", 0.0)}
    assert not language_id.identify(docs.where("false")).collect()


def test_word_scores_add_up_to_the_score_of_the_text(spark, corpus):
    docs, _, rows = corpus
    model = language_id.train(docs)
    text = next(r[1] for r in rows if r[0] == 4)
    import pyarrow as pa

    from perilweave.llm.batches import gather, words

    _, codes, known = words(pa.array([text]))
    grams, at, counts = language_id.word_grams(known)
    own = gather(grams, at, counts, codes)
    x = np.bincount(own, minlength=language_id.DIMENSIONS) / len(own) * model.idf
    logits = (x @ model.weights + model.bias) / model.temperature
    best = np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum()
    got = docs.where("doc_id = 4").select(language_id.language_column(model).alias("f")).first().f
    assert got.lang_pred == model.languages[best.argmax()] and abs(got.score - best.max()) < 1e-9


def test_quality_keeps_clean_and_drops_junk(spark, corpus):
    docs, labels, rows = corpus
    got = quality.select(docs, labels).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    clean = [i for i in range(600) if i % 5 and i % 4 != 1]
    assert np.mean([by_id[i].selected for i in clean]) > 0.97
    assert np.mean([by_id[i].selected for i in range(0, 600, 5)]) < 0.1
    assert not by_id[600].selected and not by_id[601].selected
    kept = quality.selected_rows(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r.doc_id) for r in got if r.selected)
    unlabelled = quality.select(docs, labels.where("false")).collect()
    assert all(r.selected for r in unlabelled)
    assert not quality.select(docs.where("false"), labels).collect()


def test_quality_drops_texts_of_repeated_words(spark):
    draw, rows, labels = np.random.default_rng(4), [], []
    syllables = [a + b for a in "bdfghklmnprst" for b in "aeiou"]
    known = np.array(["".join(draw.choice(syllables, draw.integers(1, 4))) for _ in range(3000)])
    for i in range(800):
        words = list(known[(3000 * draw.random(draw.integers(100, 600)) ** 2).astype(int)])
        if i % 20 == 0:
            half, times = len(words) // 2, int(draw.integers(6, 15))
            words = words[:half] + [w for w in words[half : half + half // times + 1] for _ in range(times)]
        elif i % 5 == 0:
            words = [w + "&&&" for w in words]
        rows.append((i, " ".join(words)))
        if i % 3 == 0:
            labels.append((i, int(i % 5 != 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    kept = {r.doc_id for r in quality.select(docs, labels).where("selected").collect()}
    assert np.mean([i in kept for i in range(800) if i % 5]) > 0.97
    assert np.mean([i in kept for i in range(0, 800, 20)]) < 0.05


def test_gumbel_edge_is_the_k_th_largest_key(spark):
    draw = np.random.default_rng(8)
    values = np.concatenate([draw.normal(size=500), np.full(300, 0.25), [1e6, -1e6]])
    keys = spark.createDataFrame([(float(v),) for v in values], "key double")
    for k in (1, 2, 150, 300, 400, 802):
        assert quality.top_k_edge(keys, k) == np.sort(values)[::-1][k - 1]
    assert quality.top_k_edge(keys, 0) == float("inf")


def test_ratio_counts_every_n_gram(spark):
    import pyarrow as pa

    buckets, offsets = quality.n_gram_buckets(pa.array(["a b a", None, "", "one", "x,y"]))
    assert np.diff(offsets).tolist() == [5, 0, 0, 1, 5]
    assert buckets[0] == buckets[2] and buckets.max() < quality.BUCKETS


def test_toxicity_of_unlabelled_rows(spark, corpus):
    docs, labels, rows = corpus
    got = toxicity.grade(docs, labels).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    toxic = {i: i % 4 == 1 for i in range(0, 600)}
    assert np.mean([by_id[i].toxic == toxic[i] for i in range(0, 600)]) > 0.97
    assert not any(by_id[i].toxic for i in (600, 601, 603))
    assert by_id[600].severity == 0 and all(0 <= r.severity <= 2 for r in got)
    for r in got:
        assert (r.p_toxic >= 0.5) == r.toxic
    unlabelled = toxicity.grade(docs, labels.where("false")).collect()
    assert all(r.severity is None and not r.toxic for r in unlabelled)
    assert not toxicity.grade(docs.where("false"), labels).collect()


def test_thresholds_share_weights_and_stay_in_order(spark, corpus):
    docs, labels, _ = corpus
    model = toxicity.train(docs, labels)
    assert np.all(np.diff(model.thresholds) > 0) and len(model.digests) == len(model.weights)
