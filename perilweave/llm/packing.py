"""Best-fit packing of token sequences by exact complements of their lengths.

Only lengths matter for the plan, and there are at most ``room`` of them, so the
plan is made from the histogram of all pieces, whatever their number. Pieces
find their place in it by their rank among the pieces of their length.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from perilweave.session import materialize

from .batches import byte_letters, slices
from .bpe import PRE_TOKEN
from .token_counts import library_tokenizer, splice

RANK_BITS = 44
# Longer texts go to the library in overlapping chunks.
WHOLE_CHARS = 1 << 18


# ---------------------------------------------------------------- tokens


class Encoder:
    """Ids of whole texts as the tokenizers library gives them for a byte-level vocabulary file.

    Where the order of the merges is the order of the ids, the tiktoken library
    finds the same ids in a third of the time, and is used; a vocabulary of
    another kind and a text that tiktoken refuses go to the tokenizers library.
    """

    def __init__(self, path: str):
        self.library = library_tokenizer(path)
        with open(path, encoding="utf-8") as f:
            self.fast = self._ranked(json.load(f))

    @staticmethod
    def _ranked(spec: dict):
        import tiktoken

        model, special = spec["model"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        step = spec.get("pre_tokenizer") or {}
        plain = (step.get("type"), step.get("add_prefix_space"), step.get("use_regex", True)) == ("ByteLevel", False, True)
        if not plain or spec.get("normalizer") or model.get("ignore_merges") or model.get("dropout"):
            return None
        letters = {chr(letter): byte for byte, letter in byte_letters().items()}
        vocabulary = {t: i for t, i in model["vocab"].items() if t not in special}
        if not all(c in letters for t in vocabulary for c in t):
            return None
        merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != sorted(set(merged)) or len(merged) + 256 != len(vocabulary):
            return None
        ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items()}
        return tiktoken.Encoding("vocabulary", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> np.ndarray:
        if len(text) > WHOLE_CHARS:
            return np.concatenate(splice(self.library, text))
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)
            except BaseException as e:  # its regular expressions give up on very long runs of white space
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, room: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and place (slice, ordinal) of every piece.

    A document is its ids and the end id. More than ``room`` of them are cut
    into pieces of ``room``, the first of which takes what is left over.
    ``ordinal`` numbers the pieces of one length within a task's rows.
    """

    def run(batches):
        encode, seen, task = encoder(tokenizer_path), np.zeros(room + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            for begin, stop in slices(batch.column("text")):
                part = batch.slice(begin, stop - begin)
                row, number, starts, lengths, sums = [], [], [], [], []
                for i, text in enumerate(pc.fill_null(part.column("text"), "").to_pylist()):
                    ids = np.append(encode(text), np.uint32(end_id)).astype("<u4").tobytes()
                    at, end = 0, (len(ids) // 4 - 1) % room + 1
                    while at * 4 < len(ids):
                        row.append(i)
                        number.append(len(range(0, at, room)))
                        starts.append(at)
                        lengths.append(end - at)
                        sums.append(zlib.crc32(ids[4 * at : 4 * end]))
                        at, end = end, end + room
                length = np.array(lengths, np.int64)
                order = np.argsort(length, kind="stable")
                counts = np.bincount(length, minlength=room + 1)
                ordinal = np.empty(len(length), np.int64)
                first = np.cumsum(counts) - counts
                ordinal[order] = np.arange(len(length)) - first[length[order]] + seen[length[order]]
                seen += counts
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(row, pa.int64())),
                        pa.array(number, pa.int32()),
                        pa.array(starts, pa.int64()),
                        pa.array(length),
                        pa.array(sums, pa.int64()),
                        pa.array(np.full(len(length), task, np.int32)),
                        pa.array(ordinal),
                    ],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "slice", "ordinal"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, slice int, ordinal long"
    )


# ---------------------------------------------------------------- plan


class Lengths:
    """Which lengths are still there, and an index of the sums of two of them."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(object)  # exact, whatever the size
        self.have = counts > 0
        n = len(counts)
        self.sums = np.zeros(2 * n, np.int64)  # ordered pairs of present lengths by their sum
        for a in np.flatnonzero(self.have):
            self.sums[a : a + n] += self.have

    def times(self, group: tuple[int, ...]) -> int:
        """How often the group can be taken."""
        return min(self.left[x] // group.count(x) for x in group)

    def take(self, group: tuple[int, ...], times: int) -> None:
        for x in group:
            self.left[x] -= times
            if not self.left[x] and self.have[x]:
                # Pairs (x, y) and (y, x) go, and (x, x) only once.
                self.sums[x : x + len(self.have)] -= 2 * self.have
                self.sums[2 * x] += 1
                self.have[x] = False

    def _pairs(self, total: int, largest: int):
        """Present pairs a >= b with a + b = total, a at most ``largest``, longest first."""
        if total < 2 or not self.sums[total]:
            return
        low, high = (total + 1) // 2, min(total - 1, largest)
        a = np.arange(high, low - 1, -1)
        for x in a[self.have[a] & self.have[total - a]].tolist():
            yield x, total - x

    def filling(self, length: int, room: int, others: int) -> tuple[int, ...] | None:
        """A group of ``length`` and up to ``others`` (three at most) lengths more that adds up to ``room``."""
        gap = room - length
        if gap > 0 and self.have[gap] and self.times((length, gap)):
            return length, gap
        if others > 1:
            for pair in self._pairs(gap, length):
                if self.times((length, *pair)):
                    return length, *pair
        if others < 3 or gap < 3:
            return None
        c = np.arange(min(gap - 2, length), 0, -1)
        for x in c[self.have[c] & (self.sums[gap - c] > 0)].tolist():
            for pair in self._pairs(gap - x, x):
                if self.times((length, x, *pair)):
                    return length, x, *pair
        return None


Kinds = list[tuple[list[tuple[int, int]], int]]


def _packed(counts: np.ndarray, room: int, others: int, least: int) -> Kinds:
    lengths = Lengths(np.asarray(counts))
    kinds: Kinds = []
    if lengths.left[room]:
        kinds.append(([(room, 1)], int(lengths.left[room])))
        lengths.take((room,), lengths.left[room])
    for x in range(room - 1, least - 1, -1):
        while lengths.left[x] and (group := lengths.filling(x, room, others)) is not None:
            times = lengths.times(group)
            lengths.take(group, times)
            kinds.append(([(y, group.count(y)) for y in dict.fromkeys(group)], int(times)))
    open_with: list[Kinds] = [[] for _ in range(room)]
    for x in range(room - 1, 0, -1):
        left = int(lengths.left[x])
        while left:
            rest = next((r for r in range(x, room) if open_with[r]), room)
            content, there = open_with[rest].pop() if rest < room else ([], left)
            each = rest // x if left >= rest // x else left
            used = min(there, left // each)
            if rest < room and there > used:
                open_with[rest].append((content, there - used))
            open_with[rest - each * x].append(([*content, (x, each)], used))
            left -= used * each
    return kinds + [kind for kinds_open in open_with for kind in kinds_open]


def pack_lengths(counts: np.ndarray, room: int) -> Kinds:
    """Kinds of sequences, as ([(length, how many of it)], how many sequences), for ``counts`` by length.

    Lengths are taken from the longest down. As long as one, two or three
    others fill the rest of a sequence exactly, that group is taken as often as
    all its lengths last. What finds no such complement goes, again from the
    longest down, where it leaves the least room, or else opens a sequence;
    sequences alike are handled together. Complements of several short pieces
    can leave long ones without any, so the plan is made with one, two and
    three others, and with complements sought for all lengths or only those
    over half the room; the one with the fewest sequences counts.
    """
    plans = [_packed(counts, room, others, least) for least in (1, room // 2 + 1) for others in (3, 2, 1)]
    return min(plans, key=lambda kinds: sum(times for _, times in kinds))


class Places:
    """Sequence and offset of the piece with a given rank among those of its length."""

    def __init__(self, kinds: Kinds):
        rows, next_rank, sequence = [], {}, 0
        for content, times in kinds:
            offset = 0
            for length, each in content:
                first = next_rank.get(length, 0)
                rows.append((length << RANK_BITS | first, first, each, sequence, offset))
                next_rank[length] = first + each * times
                offset += each * length
            sequence += times
        rows.sort()
        self.key, self.first, self.each, self.sequence, self.offset = np.array(rows, np.int64).reshape(-1, 5).T.copy()
        self.sequences = sequence

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, length << RANK_BITS | rank, "right") - 1
        nth = rank - self.first[at]
        return self.sequence[at] + nth // self.each[at], self.offset[at] + nth % self.each[at] * length


# ---------------------------------------------------------------- operator


def packed_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, room: int = 1024) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of ``docs(doc_id, text)``.

    Each document's ids, ended by ``end_id``, lie whole in one sequence of at
    most ``room`` ids, or in pieces if there are more (``pieces``). Offsets are
    gapless from 0 in every sequence. A null or empty text is the end id alone;
    texts of any length are encoded whole; repeated rows are packed each; a null
    doc_id stays null; pieces of equal length are interchangeable and take
    their places in the order of their tasks; an empty table gives an empty
    one; other columns are ignored.

    Texts are read once and never shuffled. The driver sees the histogram of
    lengths (at most ``room`` rows) and makes the plan, which is bounded by the
    number of lengths; ranks come from the counts by task and length.
    """
    found = materialize(pieces(docs, tokenizer_path, end_id, room), "pieces")
    counts = materialize(found.groupBy("slice", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = np.zeros(room + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row a length
        histogram[row.length] = row.n
    places = Places(pack_lengths(histogram, room))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("slice", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = found.join(starts, ["slice", "length"]).withColumn("rank", F.col("base") + F.col("ordinal"))

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = places(length, rank)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        place,
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
