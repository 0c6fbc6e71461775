"""Exact token counts; huge texts are encoded in overlapping chunks and spliced."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .batches import LibraryPieces, PieceTable, row_sums, slices, spaced_pieces

CHUNK_CHARS = 65_536
OVERLAP_CHARS = 256
# A pre-token that ends in a character other than white space never reaches
# over an ASCII space or line break, whatever the text on either side.
_STABLE = re.compile(r"(?<=\S)(?=[ \t\n\r])")


@lru_cache(maxsize=4)
def library_tokenizer(path: str):
    """The library's tokenizer, as the file describes it, without truncation and padding."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=4)
def library_pieces(path: str) -> PieceTable:
    return PieceTable(LibraryPieces(library_tokenizer(path)))


def splice(tokenizer, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[np.ndarray]:
    """Ids of ``text`` from overlapping chunks, as a list of runs.

    Neighbouring chunks are both encoded with offsets. They are joined at the
    first place inside their overlap where the text proves a boundary of
    pre-tokens and both encodings start a token. Where there is none (one word
    fills the overlap) the overlap doubles, up to the end of the text.
    """
    end_of_text = len(text)

    def encoded(begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        e = tokenizer.encode(text[begin:end], add_special_tokens=False)
        return np.asarray(e.ids, np.uint32), np.fromiter((o[0] for o in e.offsets), np.int64, len(e.ids)) + begin

    runs, begin, kept_from = [], 0, 0
    width = overlap
    ids, starts = encoded(0, min(chunk + width, end_of_text))
    while begin + chunk + width < end_of_text:
        follow = begin + chunk
        ids_b, starts_b = encoded(follow, min(follow + chunk + width, end_of_text))
        joint = next(
            (
                p
                for m in _STABLE.finditer(text, follow + 1, follow + width)
                if (p := m.start()) > kept_from and np.any(starts == p) and np.any(starts_b == p)
            ),
            None,
        )
        if joint is None:
            width *= 2
            ids, starts = encoded(begin, min(begin + chunk + width, end_of_text))
            continue
        runs.append(ids[np.searchsorted(starts, kept_from) : np.searchsorted(starts, joint)])
        begin, kept_from, ids, starts = follow, joint, ids_b, starts_b
        if width != overlap:
            width = overlap
            ids, starts = encoded(begin, min(begin + chunk + width, end_of_text))
    runs.append(ids[np.searchsorted(starts, kept_from) :])
    return runs


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    limit: int = 1024,
    chunk_chars: int = CHUNK_CHARS,
    overlap_chars: int = OVERLAP_CHARS,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs(doc_id, text)``.

    Counts are those of the library for the whole text, without added special
    tokens; special strings inside a text count as the library takes them. Texts
    longer than ``chunk_chars`` go through ``splice``; shorter ones are one
    chunk, of which each distinct piece is encoded once per worker. A null or
    empty text counts 0; repeated rows are counted each; a null doc_id stays
    null; other columns are ignored. No shuffle, memory bounded by a slice.
    """

    def count(batches):
        table, tokenizer = library_pieces(tokenizer_path), library_tokenizer(tokenizer_path)
        for batch in batches:
            for start, stop in slices(batch.column("text")):
                part = batch.slice(start, stop - start)
                texts = pc.fill_null(part.column("text"), "")
                long = pc.greater(pc.utf8_length(texts), chunk_chars)
                offsets, codes, known = spaced_pieces(pc.if_else(long, "", texts))
                _, _, counts = table.lookup(known)
                tokens = row_sums(counts[codes], offsets)
                for i in np.flatnonzero(long.to_numpy(zero_copy_only=False)):
                    runs = splice(tokenizer, texts[int(i)].as_py(), chunk_chars, overlap_chars)
                    tokens[i] = sum(map(len, runs))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pc.binary_length(texts).cast(pa.int64()),
                        pa.array(tokens, pa.int64()),
                        pa.array(tokens > limit),
                    ],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
