"""The pipeline's stages on a small corpus, each against what its operator decides."""

import numpy as np
import pytest

import corpus_pipeline
from perilweave.llm import mixing, quality


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    draw = np.random.default_rng(3)
    folder = tmp_path_factory.mktemp("sf")
    rows, labels = [], []
    for i in range(300):
        syllables = (["ka", "lo", "mi", "tu"], ["sch", "ung", "ver", "ent"])[i % 2]
        words = ["".join(draw.choice(syllables, draw.integers(1, 4))) for _ in range(draw.integers(8, 60))]
        good = i % 6 != 0
        if not good:
            words = [w + "&&&" for w in words]
        rows.append((i, " ".join(words), ("aa", "bb")[i % 2], f"s{i % 3}", 0))
        labels.append((i, int(good), 0))
    copies = [(300 + i, rows[i][1] + (" end" if i % 2 else ""), rows[i][2], "s9", 0) for i in range(1, 40)]
    rows += copies + [(900, None, None, None, 0), (901, "12 34", "aa", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.selectExpr("doc_id", "text", "lang", "source", "length(text) as n_chars").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages_take_effect(spark, small):
    docs, seen = spark.read.parquet(f"{small}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, small).collect(), stage(spark, docs, small).schema)
        seen.append(docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    languages, good, unique, mixed, encoded = ({r.doc_id for r in d.select("doc_id").collect()} for d in seen)
    assert not {900, 901} & languages
    clean = {i for i in range(300) if i % 6}
    assert len(clean & good) > 0.97 * len(clean)
    assert len({i for i in range(0, 300, 6)} & good) < 5
    assert not {i for i in range(301, 340) if i - 300 in unique} & unique
    assert clean & good <= unique
    want = mixing.mix_table(seen[2]).where("taken > 0")
    assert mixed == {r.doc_id for r in want.collect()} == encoded
    assert seen[3].count() == seen[4].count()


def test_texts_in_no_learned_language_are_dropped(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    strange = ["Это совсем другой язык и он не выучен", "これは日本語の文章です。学習されていません", "zzxq wqxz vvkj qqzx jjxk wwzp pqpq xzxz"]
    more = [(1000 + i, t, None, "s1", len(t)) for i, t in enumerate(strange)]
    both = docs.unionByName(spark.createDataFrame(more, docs.schema))
    kept = {r.doc_id for r in corpus_pipeline.known_language(spark, both, small).select("doc_id").collect()}
    assert not {r[0] for r in more} & kept
    assert len({i for i in range(300) if i % 6} & kept) > 0.99 * 250


def test_run_writes_each_stage(spark, small):
    out = corpus_pipeline.run(spark, small)
    assert set(out.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
    assert out.count() > 200
    assert len(corpus_pipeline.STAGES) == 5 and quality.LEAST_CHANCE < 0.5
