"""Token counts, byte pair codec and token files against the library, on small hostile texts."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from perilweave.llm import bpe, token_counts, token_files
from perilweave.llm.batches import gather, words

BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")
LOWER_CASE = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "  a  b", "a\n \nb", "x<|endoftext|> y <|ENDOFTEXT|>", "naïve   café\t\tx  ", "\x00\x01\x00 a",
    "a" * 500, "日本語 のテキスト", "12345 678's don't we'll \r\n\r\n  z", "a \x1c b\x1c \x1cc", " " * 50 + "x",
    "😀😀 👩‍👩‍👧", "end  ", "İÀÉ ÖÄ'S It's x.' 's", "a\xa0b \x85 c", "one two\x00three", "word " * 3000, "w" * 40_000,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", 1.5) for i, t in enumerate(TEXTS)]
    rows += [(None, "no id", "x", 0.0), (3, "  a  b", "again", 0.0), (3, "  a  b", "again", 0.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens double").repartition(3)


def library(path, text):
    return token_counts.library_tokenizer(path).encode(text or "", add_special_tokens=False).ids


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_counts_equal_the_library_with_and_without_chunks(docs):
    for chunk, overlap in ((65_536, 256), (700, 16), (5, 2)):
        got = rows_of(token_counts.token_counts(docs, BYTE_LEVEL, 100, chunk, overlap))
        want = []
        for r in docs.collect():
            n = len(library(BYTE_LEVEL, r.text))
            want.append((r.doc_id, len((r.text or "").encode()), n, n > 100))
        assert got == sorted(want, key=repr)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab é1'.s \n\t\x85!", min_size=1, max_size=60), st.integers(1, 9), st.integers(1, 4))
def test_splice_gives_the_ids_of_the_whole_text(text, chunk, overlap):
    runs = token_counts.splice(token_counts.library_tokenizer(BYTE_LEVEL), text, chunk, overlap)
    assert np.concatenate(runs).tolist() == library(BYTE_LEVEL, text)


def test_codec_round_trip_equals_the_library(docs):
    got = rows_of(bpe.round_trip(docs, BYTE_LEVEL))
    tokenizer, want = token_counts.library_tokenizer(BYTE_LEVEL), []
    for r in docs.collect():
        ids = library(BYTE_LEVEL, r.text)
        text = tokenizer.decode(ids, skip_special_tokens=False).encode()
        digest = lambda b: hashlib.sha256(b).hexdigest()
        want.append((r.doc_id, len(ids), digest(np.array(ids, "<u4").tobytes()), digest(text)))
    assert got == sorted(want, key=repr)


def test_ids_decode_to_the_texts(docs):
    kept = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    back = bpe.decode(bpe.encode(kept, BYTE_LEVEL), BYTE_LEVEL)
    assert rows_of(back) == sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=repr)


def test_pair_compatibility_is_what_merging_gives():
    coder, tokenizer = bpe.codec(BYTE_LEVEL), token_counts.library_tokenizer(BYTE_LEVEL)
    draw = random.Random(5)
    letters = [i for i, b in enumerate(coder.spelling) if b.isalpha() and len(b) <= 5]
    for _ in range(3000):
        a, b = draw.choice(letters), draw.choice(letters)
        text = (coder.spelling[a] + coder.spelling[b]).decode()
        assert coder.compatible(a, b) == (tokenizer.encode(text, add_special_tokens=False).ids == [a, b])


def test_lower_case_pieces_equal_the_library():
    import pyarrow as pa

    table = token_files.lower_case_pieces(LOWER_CASE)
    for text in TEXTS:
        offsets, codes, known = words(pa.array([text], pa.string()))
        flat, at, counts = table.lookup(known)
        assert gather(flat, at, counts, codes).tolist() == library(LOWER_CASE, text)


def test_token_files_hold_what_was_written(docs, spark, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    manifest = token_files.write_token_files(docs, LOWER_CASE, 2, folder).orderBy("part").collect()
    assert sum(m.n_docs for m in manifest) == docs.count()
    assert [m.base for m in manifest] == [sum(x.n_tokens for x in manifest[:i]) for i in range(len(manifest))]
    got = token_files.token_files(docs, LOWER_CASE, 2).collect()
    seen = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in seen] == sorted((r.doc_id for r in docs.collect()), key=lambda x: (x is not None, x))
    at = 0
    for r in seen:
        assert r.start == at
        at += r.n_tokens
    by_id = {r.doc_id: r.text for r in docs.collect()}
    for r in seen:
        ids = [*library(LOWER_CASE, by_id[r.doc_id]), 2]
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert not token_counts.token_counts(none, BYTE_LEVEL).collect()
    assert not bpe.round_trip(none, BYTE_LEVEL).collect()
    assert not token_files.token_files(none, LOWER_CASE, 2).collect()
