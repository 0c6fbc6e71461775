"""The corpus pipeline: language, quality, near duplicates, mixing, encoding."""

from __future__ import annotations

from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perilweave.llm import bpe, jaccard_join, language_id, mixing, quality
from perilweave.llm.queries import BYTE_LEVEL, table
from perilweave.session import materialize

# Stages that learn models or run a vocabulary are not expressible in SQL.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter, and those in no learned language or open between several."""
    model = language_id.train(docs.where(~language_id.held_out()))
    found = language_id.language_column(model)
    if model is None:
        return docs.where(F.col("text").rlike("\\p{L}"))
    return docs.where((found["lang_pred"] != language_id.UNKNOWN) & found["known"])


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the importance sampler selects."""
    return quality.selected_rows(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each group of near duplicates."""
    return jaccard_join.representatives(docs, n=5, threshold=Fraction(4, 5), band_steps=1)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and cut sources to their targets, in training order."""
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    return bpe.round_trip(docs, public_tokenizers.path(BYTE_LEVEL))


STAGES = [
    ("language ID", known_language),
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each),
    ("mixing sources to target weights", mixed),
    ("BPE encoding and decoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each one written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
