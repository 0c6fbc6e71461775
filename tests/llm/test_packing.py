"""Packing: ids and cuts against the library, places that fit, counts near the bound."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from perilweave.llm import packing, token_counts

BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "a b c", "x<|endoftext|> y", "日本語 のテキスト", "word " * 900, "q" * 4000, " " * 3000, "one two three four. " * 40]


def packed_ids(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("room", [16, 100, 1024])
def test_pieces_are_those_of_the_library_and_sequences_are_gapless(spark, room):
    rows = [(i % 40 if i % 9 else None, TEXTS[i % len(TEXTS)] if i % 3 else f"copy {i % 5}", 1, "clash") for i in range(160)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int, sequence_id string").repartition(6)
    got = packing.packed_pieces(df, BYTE_LEVEL, 2, room).collect()
    want = []
    for doc_id, text, *_ in rows:
        ids = token_counts.library_tokenizer(BYTE_LEVEL).encode(text or "", add_special_tokens=False).ids + [2]
        cuts = [0, *range((len(ids) - 1) % room + 1, len(ids) + 1, room)]
        want += [(doc_id, n, a, b - a, packed_ids(ids[a:b])) for n, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((tuple(r[:5]) for r in got), key=repr) == sorted(want, key=repr)
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= room
    assert len(held) <= fewest_by_best_fit([r.length for r in got], room)


def fewest_by_best_fit(lengths, room):
    free = []
    for x in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(free) if r >= x]
        if fits:
            free[min(fits, key=lambda i: free[i])] -= x
        else:
            free.append(room - x)
    return len(free)


def test_an_empty_table_has_no_pieces(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.packed_pieces(df, BYTE_LEVEL, 2).isEmpty()


@pytest.mark.parametrize("most", [3, 60, 100_000])
def test_plans_use_every_piece_once_and_stay_near_the_bound(most):
    rng = np.random.default_rng(most)
    for _ in range(12):
        room = int(rng.integers(5, 1025))
        counts = np.zeros(room + 1, np.int64)
        present = rng.integers(1, room + 1, room)
        counts[present] = rng.integers(1, most + 1, room)
        kinds = packing.pack_lengths(counts, room)
        used = np.zeros(room + 1, np.int64)
        for content, times in kinds:
            assert times > 0 and sum(x * n for x, n in content) <= room
            for x, n in content:
                used[x] += n * times
        assert (used == counts).all()
        places = packing.Places(kinds)
        length = int(present[0])
        rank = np.unique(rng.integers(0, counts[length], 50))
        sequence, offset = places(np.full(len(rank), length), rank)
        assert len(set(zip(sequence.tolist(), offset.tolist()))) == len(rank)
        assert (offset + length <= room).all() and (sequence < places.sequences).all()


def test_complements_of_one_two_and_three_lengths_fill_exactly():
    counts = np.zeros(101, np.int64)
    for x, n in {60: 5, 40: 5, 70: 3, 18: 3, 12: 3, 90: 2, 5: 2, 3: 2, 2: 2}.items():
        counts[x] = n
    kinds = packing.pack_lengths(counts, 100)
    assert sum(times for _, times in kinds) == 10
    assert all(sum(x * n for x, n in content) == 100 for content, _ in kinds)


def test_the_fast_encoder_gives_the_ids_of_the_library():
    encode = packing.Encoder(BYTE_LEVEL)
    assert encode.fast is not None
    odd = [chr(c) for c in (0x1905F, 0x125BC, 0x12628, 0x85, 0xA0, 0x1C, 0x2028, 0x345, 0x1D7D8)]
    texts = [t or "" for t in TEXTS] + [f"a{c}'m 1{c} {c}'s!" for c in odd] + [" " * 150_000 + "x", "ab'" * 40_000, "w" * 300_000]
    for text in texts:
        assert encode(text).tolist() == encode.library.encode(text, add_special_tokens=False).ids


def test_a_vocabulary_of_another_kind_goes_to_the_library():
    assert packing.Encoder(public_tokenizers.path("word_bpe_49k.json")).fast is None
