"""Arrow and numpy helpers that run inside tasks, on bounded slices of a batch."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 3 << 20
SEPARATOR = "\x00\x01\x00"
# White space of any library's notion on either side of a space.
_BESIDE_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}] | [\s\x0B\x1C-\x1F\x{85}\p{Z}]"
_SAFE_CUT = re.compile(r"(?<=\S)(?= )|(?= \S)")


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges that hold about ``limit`` bytes of text, one row at least."""
    if not len(texts):
        return
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    block = (np.cumsum(sizes) - sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(texts)]
    yield from zip(cuts[:-1], cuts[1:])


def _encoded(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    return offsets - offsets[0], coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Runs of anything but ASCII white space: (row offsets, word codes, distinct words).

    A null text has no words. ``lower`` folds A-Z only.
    """
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    offsets, codes, known = _encoded(pc.ascii_split_whitespace(texts))
    filled = pc.binary_length(known).to_numpy(zero_copy_only=False) > 0
    if not filled.all():
        keep = filled[codes]
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        codes = codes[keep]
    return offsets, codes, known


def spaced_pieces(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Texts cut before spaces where a byte-level pre-tokenizer surely cuts too.

    Such a space follows a character that is not white space, or is followed by
    one: the pre-token before it cannot reach over the space, and the one that
    starts with it takes no account of what stands before. Joining a row's
    pieces gives its text.
    """
    texts = pc.fill_null(texts, "")
    marked = pc.replace_substring(texts, " ", SEPARATOR + " ")
    odd = pc.or_(
        pc.match_substring_regex(texts, _BESIDE_SPACE), pc.match_substring(texts, SEPARATOR)
    )
    if not pc.any(odd).as_py():
        return _encoded(pc.split_pattern(marked, SEPARATOR))
    rows = []
    for text, strange in zip(texts.to_pylist(), odd.to_pylist()):
        if strange:
            rows.append(_SAFE_CUT.split(text))
        else:
            head, *rest = text.split(" ")
            rows.append([head, *(" " + x for x in rest)])
    return _encoded(pa.array(rows, pa.list_(pa.string())))


class Recent:
    """A dictionary of what was used lately, in two generations of bounded size."""

    def __init__(self, limit: int = 80_000):
        self.limit, self.young, self.old = limit, {}, {}

    def get(self, key):
        value = self.young.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        self.young[key] = value


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return array("I", ids).tobytes()


class PieceTable:
    """Packed ids of text pieces; those met lately are remembered."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], longest: int = 64, limit: int = 80_000):
        self.encode, self.longest, self.known = encode, longest, Recent(limit)

    def lookup(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(all ids, first position, count) of each piece."""
        names = pieces.to_pylist()
        found = list(map(self.known.young.get, names))
        missing = []
        for i, x in enumerate(found):
            if x is None and (x := self.known.get(names[i])) is None:
                missing.append(i)
            found[i] = x
        for i, ids in zip(missing, self.encode([names[i] for i in missing]) if missing else ()):
            found[i] = ids
            if len(names[i]) <= self.longest:
                self.known.put(names[i], ids)
        counts = np.fromiter(map(len, found), np.int64, len(found)) // 4
        return np.frombuffer(b"".join(found), "<u4"), np.cumsum(counts) - counts, counts


def byte_letters() -> dict[int, int]:
    """The letter (as a code point) that stands for each byte in a byte-level vocabulary.

    Printable bytes stand for themselves, the others for the letters from 256 on.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


class LibraryPieces:
    """Packed ids that a library's byte-level tokenizer gives for separate pieces.

    A letter and the ASCII signs after it are never one pre-token, so a word
    and the signs that follow it are encoded apart, each once. A word of Latin
    letters, which needs no normalising but ``fold``, goes to the library's
    model directly; everything else passes through the whole tokenizer.
    """

    # An apostrophe may start a contraction, so it is no such sign.
    WORD_AND_SIGNS = re.compile(r"( ?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([!-&(-/:-@\[-`{-~]*)")

    def __init__(self, tokenizer, fold: Callable[[str], str] = str):
        self.tokenizer, self.model, self.fold = tokenizer, tokenizer.model, fold
        self.letters, self.parts = byte_letters(), Recent()

    def _word(self, word: str) -> bytes:
        spelled = self.fold(word).encode().decode("latin-1").translate(self.letters)
        return packed([t.id for t in self.model.tokenize(spelled)])

    def _part(self, part: str, encode: Callable[[str], bytes]) -> bytes:
        found = self.parts.get(part)
        if found is None:
            found = encode(part)
            if len(part) <= 64:
                self.parts.put(part, found)
        return found

    def __call__(self, pieces: list[str]) -> list[bytes]:
        out, rest = [], []
        whole = lambda part: packed(self.tokenizer.encode(part, add_special_tokens=False).ids)
        for i, piece in enumerate(pieces):
            if (m := self.WORD_AND_SIGNS.fullmatch(piece)) is None:
                out.append(b"")
                rest.append(i)
            elif not m[2]:
                out.append(self._word(piece))
            else:
                out.append(self._part(m[1], self._word) + self._part(m[2], whole))
        found = self.tokenizer.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False)
        for i, e in zip(rest, found):
            out[i] = packed(e.ids)
        return out


def gather(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that the codes name, one after the other."""
    length = counts[codes]
    before = np.cumsum(length) - length
    total = int(length.sum())
    return flat[np.repeat(starts[codes] - before, length) + np.arange(total)]


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values between successive offsets; 0 for an empty row."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def mix64(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a fixed published finaliser)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def word_hashes(known: pa.Array) -> np.ndarray:
    """A 64-bit hash of each distinct word."""
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(x) for x in known.to_pylist()), np.uint64, len(known))
