"""Byte pair encoding by dynamic programming over prefixes, and decoding."""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .batches import PieceTable, byte_letters, gather, packed, slices, spaced_pieces

NEVER = 1 << 60
# A letter and the ASCII signs after it are never one pre-token (an apostrophe
# may start a contraction, so it is no such sign): two pre-tokens by themselves.
WORD_AND_SIGNS = (
    r"^(?P<word> ?[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+)(?P<signs>[!-&(-/:-@\[-`{-~]*)$"
)
# Fixed value: the published pre-token pattern of byte-level vocabularies.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        import ahocorasick
        import regex
        from tokenizers import pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = {chr(letter): byte for byte, letter in byte_letters().items()}
        vocabulary = spec["model"]["vocab"]
        size = max([*vocabulary.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.spelling = [b""] * size
        for token, i in vocabulary.items():
            self.spelling[i] = bytes(letters[c] for c in token)
        self.born = [-1] * size
        self.halves: list[tuple[int, int]] = [(-1, -1)] * size
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, whole = vocabulary[left], vocabulary[right], vocabulary[left + right]
            self.merges[a << 32 | b] = rank
            if self.born[whole] < 0:
                self.born[whole], self.halves[whole] = rank, (a, b)
        self.automaton = ahocorasick.Automaton()
        for i, token in enumerate(self.spelling):
            if token and (len(token) == 1 or self.born[i] >= 0):
                self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()
        self.pre_token = regex.compile(PRE_TOKEN)
        self.library_cutter = pre_tokenizers.ByteLevel(add_prefix_space=False)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.special.items():
            self.spelling[i] = content.encode()
        self.specials = (
            regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
            if self.special
            else None
        )
        self.tested: dict[int, bool] = {}
        self.tested_before: dict[int, bool] = {}
        lengths = np.fromiter(map(len, self.spelling), np.int64, size)
        self.spelled = np.frombuffer(b"".join(self.spelling), np.uint8)
        self.spelled_at, self.spelled_n = np.cumsum(lengths) - lengths, lengths
        self.forget()

    def forget(self) -> None:
        """Drop what is remembered of texts; a task starts and ends without it."""
        self.pre_tokens = PieceTable(self.encode_pre_tokens, limit=160_000)
        self.pieces = PieceTable(self.encode_pieces, limit=20_000)

    def compatible(self, a: int, b: int) -> bool:
        """Does encoding the bytes of token a, then those of token b, give just [a, b]?

        The merges that built both are undone, latest first. The two pieces that
        meet at the seam at any time must not merge with each other before one
        of them is merged away from the seam; of equal merges the left one goes
        first.
        """
        key = a << 32 | b
        if key in self.tested_before:
            self.tested[key] = answer = self.tested_before[key]
            return answer
        born, left_until, right_until, answer = self.born, NEVER, NEVER, True
        while True:
            rank = self.merges.get(a << 32 | b)
            if rank is not None and rank < left_until and rank <= right_until:
                answer = False
                break
            if born[a] > born[b]:
                left_until, a = born[a], self.halves[a][1]
            elif born[b] >= 0:
                right_until, b = born[b], self.halves[b][0]
            else:
                break
        if len(self.tested) > 500_000:
            self.tested_before, self.tested = self.tested, {}
        self.tested[key] = answer
        return answer

    def encode_pre_tokens(self, texts: list[str]) -> list[bytes]:
        """Packed ids of pre-tokens.

        For each prefix the automaton names the tokens that end it; exactly one
        of them is the last token of the prefix's encoding: the one compatible
        with the last token of the prefix that it leaves. What is stored for a
        prefix holds for all pre-tokens that start with it, so they are taken in
        order and each goes on where it departs from the one before.
        """
        spelled = [t if t.isascii() else t.encode().decode("latin-1") for t in texts]
        longest = max(map(len, spelled), default=0)
        last, width, previous = [-1] * (longest + 1), [0] * (longest + 1), ""
        out = [b""] * len(texts)
        for i in sorted(range(len(spelled)), key=spelled.__getitem__):
            data, shared = spelled[i], 0
            for x, y in zip(data, previous):
                if x != y:
                    break
                shared += 1
            previous, settled, known, compatible = data, shared - 1, self.tested.get, self.compatible
            matches = list(self.automaton.iter(data))
            for end, (token, length) in matches[bisect_left(matches, (shared,)) :]:
                if end == settled:
                    continue
                start = end + 1 - length
                if start:
                    before = last[start]
                    fits = known(before << 32 | token)
                    if fits is None:
                        fits = compatible(before, token)
                        known = self.tested.get
                    if not fits:
                        continue
                last[end + 1], width[end + 1], settled = token, length, end
            ids, at = [], len(data)
            while at:
                ids.append(last[at])
                at -= width[at]
            ids.reverse()
            out[i] = packed(ids)
        return out

    def cut(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings.

        Beyond Latin-1 the library's own cutter decides, as its table of letters
        is older than that of the regex package.
        """
        if text.isascii() or max(text) <= "\xff":
            return self.pre_token.findall(text)
        return [text[a:b] for _, (a, b) in self.library_cutter.pre_tokenize_str(text)]

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of any texts, special strings being their own ids."""
        cuts, tokens = [], []
        for piece in pieces:
            found = len(tokens)
            for part in self.specials.split(piece) if self.specials else [piece]:
                tokens += [part] if part in self.special else self.cut(part)
            cuts.append((found, len(tokens)))
        distinct = dict.fromkeys(tokens)
        plain = [t for t in distinct if t not in self.special]
        distinct.update(zip(plain, self.encode_pre_tokens(plain)))
        distinct.update((t, packed([i])) for t, i in self.special.items())
        return [b"".join(map(distinct.__getitem__, tokens[a:b])) for a, b in cuts]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, offsets of the texts)."""
        offsets, codes, known = spaced_pieces(texts)
        parts = pc.extract_regex(known, WORD_AND_SIGNS)
        plain = parts.is_valid()
        words = parts.field("word").filter(plain).dictionary_encode()
        signs = parts.field("signs").filter(plain).dictionary_encode()
        found = [
            self.pre_tokens.lookup(words.dictionary),
            self.pre_tokens.lookup(signs.dictionary),
            self.pieces.lookup(known.filter(pc.invert(plain))),
        ]
        # Runs of ids: words, then signs, then other pieces; a piece is one run or two.
        flat, counts = np.concatenate([f[0] for f in found]), np.concatenate([f[2] for f in found])
        starts = np.cumsum(counts) - counts
        plain = plain.to_numpy(zero_copy_only=False)
        runs_of = np.where(plain, 2, 1)
        at = np.cumsum(runs_of) - runs_of
        runs = np.empty(int(runs_of.sum()), np.int64)
        runs[at[plain]] = words.indices.to_numpy(zero_copy_only=False)
        runs[at[plain] + 1] = signs.indices.to_numpy(zero_copy_only=False) + len(words.dictionary)
        runs[at[~plain]] = np.arange(int((~plain).sum())) + len(words.dictionary) + len(signs.dictionary)
        tokens = np.add.reduceat(np.append(counts[runs], 0), at) if len(at) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(tokens[codes])])
        return gather(flat, starts, counts, gather(runs, at, runs_of, codes)), ends[offsets]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The texts, in UTF-8; bytes that are none become the replacement mark."""
        flat = gather(self.spelled, self.spelled_at, self.spelled_n, ids).tobytes()
        ends = np.concatenate([[0], np.cumsum(self.spelled_n[ids])])[offsets].tolist()
        out = []
        for start, stop in zip(ends[:-1], ends[1:]):
            text = flat[start:stop]
            try:
                text.decode()
            except UnicodeDecodeError:
                text = text.decode(errors="replace").encode()
            out.append(text)
        return out


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of every row; null and empty texts have none."""

    def run(batches):
        coder = codec(path)
        for batch in batches:
            for start, stop in slices(batch.column("text")):
                part = batch.slice(start, stop - start)
                ids, offsets = coder.encode(part.column("text"))
                lists = pa.ListArray.from_arrays(
                    pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32))
                )
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row of ``encoded(doc_id, ids)``; null ids give an empty text."""

    def run(batches):
        coder = codec(path)
        for batch in batches:
            rows = [x or [] for x in batch.column("ids").to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)
            ids = np.array([i for x in rows for i in x], np.int64)
            texts = [t.decode() for t in coder.decode(ids, offsets)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"]
            )

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them.

    Every row of ``docs(doc_id, text)`` is encoded and decoded whole; a null or
    empty text has no tokens and the digests of nothing; repeated rows stay; a
    null doc_id stays null; other columns are ignored. No shuffle.
    """

    def run(batches):
        coder = codec(path)
        coder.forget()
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            for start, stop in slices(batch.column("text")):
                part = batch.slice(start, stop - start)
                ids, offsets = coder.encode(part.column("text"))
                packed, at = ids.astype("<u4").tobytes(), offsets.tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(np.diff(offsets), pa.int64()),
                        pa.array([sha(packed[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:])], pa.string()),
                        pa.array([sha(t) for t in coder.decode(ids, offsets)], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
        coder.forget()

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
