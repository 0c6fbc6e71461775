"""Registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe,
    conversations,
    embedding_dedup,
    jaccard_join,
    language_id,
    manifest,
    mixing,
    nearest_neighbours,
    oracles,
    packing,
    quality,
    token_counts,
    token_files,
    toxicity,
)

# The vocabulary files and ids that the queries are specified with.
BYTE_LEVEL = "byte_bpe_50k.json"
LOWER_CASE = "word_bpe_49k.json"
END_ID = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(
        table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_LEVEL), limit=1024
    )


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_LEVEL))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(
        table(spark, sf_dir, "documents"), public_tokenizers.path(LOWER_CASE), END_ID
    )


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(
        table(spark, sf_dir, "documents"), n=3, threshold=Fraction(9, 10), band_steps=3
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.select(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_neighbours.nearest_neighbours(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_table(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.grade(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return manifest.manifest(table(spark, sf_dir, "documents"), tampered)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    return conversations.repair(conversations.damaged(given), given)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_pieces(
        table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_LEVEL), END_ID, room=1024
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_embedding_dedup, op3_jaccard_join, op4_bpe_round_trip, op5_token_files,
        op6_language_id, op7_quality, op8_nearest_neighbours, op9_mixture, op10_toxicity, op11_merkle_manifest,
        op12_conversation_repair, op13_packing,
    )
}
WORDS = "[^\\x20\\x09-\\x0D]+"
FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _due_sql(mix: mixing.Mix, demand: str) -> str:
    """``mixing.invert`` in SQL, by weight number."""
    cases = []
    for i, knots in enumerate(mix.schedules):
        areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots[:-1], knots[1:])]
        whole, below, branches = sum(areas), 0.0, ""
        for (t0, w0), (t1, w1), area in zip(knots[:-1], knots[1:], areas):
            rest = f"({demand} * {whole}e0 - {below}e0)"
            root = f"sqrt(greatest({w0 * w0}e0 + {2 * ((w1 - w0) / (t1 - t0))}e0 * {rest}, 0e0))"
            due = f"least({t0}e0 + 2 * {rest} / greatest({w0}e0 + {root}, 1e-12), {knots[-1][0]}e0)"
            branches += f" WHEN {demand} <= {(below + area) / whole}e0 THEN {due}"
            below += area
        cases.append(f"WHEN {i} THEN CASE{branches} ELSE {knots[-1][0]}e0 END")
    return f"CASE weight_no {' '.join(cases)} END"


MIX = mixing.Mix()
ORACLES: dict[str, str] = {
    "op11_merkle_manifest": oracles.MANIFEST,
    "op12_conversation_repair": oracles.CONVERSATIONS,
    "op2_embedding_dedup": """
        WITH RECURSIVE v AS (
          SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
        u AS (
          SELECT * FROM v WHERE label IS NOT NULL AND vec_id IS NOT NULL AND e IS NOT NULL
            AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND len(list_filter(e, lambda x: x <> 0)) > 0),
        edge AS (
          SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
        reach AS (
          SELECT vec_id AS node, vec_id AS root FROM v
          UNION SELECT b, root FROM reach JOIN edge ON a = node),
        n AS (SELECT a, count(*) AS n FROM edge GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, min(root) AS component_id, vec_id = min(root) AS kept
        FROM v JOIN reach ON node = vec_id LEFT JOIN n ON a = vec_id GROUP BY vec_id, n""",
    "op9_mixture": f"""
        WITH d AS (
          SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) AS size,
            md5(CAST(doc_id AS VARCHAR)) AS digest FROM documents),
        k AS (
          SELECT *, CAST('0x' || substr(digest, 1, 8) AS BIGINT) % {mixing.BUCKETS} AS bucket FROM d),
        s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
        w AS (
          SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight_no FROM s),
        v AS (SELECT *, list_value{MIX.weights}[weight_no + 1] AS weight FROM w),
        r AS (
          SELECT *, 2e0 * source_size / weight AS full_at, row_number() OVER (ORDER BY 2e0 * source_size / weight, source NULLS LAST) AS n,
            (SELECT sum(source_size) FROM s) * 3 / 2e0
              - coalesce(sum(2 * source_size) OVER o, 0) AS rest,
            (SELECT sum(weight) FROM v) - coalesce(sum(weight) OVER o, 0) AS open
          FROM v WINDOW o AS (ORDER BY 2e0 * source_size / weight, source NULLS LAST
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        level AS (SELECT arg_min(rest / open, n) FILTER (rest / open <= full_at) AS level FROM r),
        t AS (
          SELECT source, source_size, weight_no,
            least(CAST(2 * source_size AS DOUBLE), level * weight) AS target FROM v, level),
        p AS (
          SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, weight_no,
            CAST(floor(target) AS BIGINT) AS whole,
            CAST(coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY bucket, digest, doc_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
          FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source),
        c AS (
          SELECT *, greatest(0, least(size, whole - start)) AS words_1,
            greatest(0, least(size, whole - start - source_size)) AS words_2 FROM p)
        SELECT doc_id, size, source_size, target, words_1 + words_2 AS taken, words_1, words_2,
          CASE WHEN words_1 > 0 THEN {_due_sql(MIX, "(start / target)")} END AS position_1,
          CASE WHEN words_2 > 0 THEN {_due_sql(MIX, "((start + source_size) / target)")} END AS position_2
        FROM c""",
    "op3_jaccard_join": f"""
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all(coalesce({FOLDED}, ''), '{WORDS}') AS ws FROM documents),
        s AS (
          SELECT DISTINCT doc_id, unnest(CASE
            WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: concat_ws(' ', ws[i], ws[i + 1], ws[i + 2]))
            WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM w),
        n AS (
          SELECT w.doc_id, count(shingle) AS n_shingles FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
        common AS (
          SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
          FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
        link AS (
          SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
          WHERE 100 * c >= 90 * (x.n_shingles + y.n_shingles - c)),
        edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        reach AS (
          SELECT doc_id AS node, doc_id AS root FROM n
          UNION SELECT b, root FROM reach JOIN edge ON a = node)
        SELECT n.doc_id, n_shingles, min(root) AS component_id FROM n JOIN reach ON node = n.doc_id GROUP BY 1, 2""",
}
