"""Flat token-id files with 64-bit document offsets, written and read by Spark tasks."""

from __future__ import annotations

import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from perilweave.session import materialize, shared_dir

from .batches import LibraryPieces, PieceTable, gather, row_sums, slices, words
from .token_counts import library_tokenizer

NO_DOCUMENT_ID = -(1 << 63)
READ_IDS = 1 << 20
KEYS_PER_PART = 50


@lru_cache(maxsize=4)
def lower_case_pieces(path: str) -> PieceTable:
    """Pieces of a vocabulary that drops white space and letter case."""
    return PieceTable(LibraryPieces(library_tokenizer(path), str.lower))


def id_type(vocabulary_size: int) -> str:
    """Little-endian unsigned integers, as wide as the vocabulary needs."""
    return "<u2" if vocabulary_size <= 1 << 16 else "<u4"


def _bounds(docs: DataFrame, parts: int) -> np.ndarray:
    """(doc_id, tie) pairs that cut the rows into ``parts`` ranges of about equal size.

    Taken from a sample of KEYS_PER_PART keys a part, by a digest of the keys;
    the sample only decides how even the parts are.
    """
    keys = docs.select(F.coalesce("doc_id", F.lit(NO_DOCUMENT_ID)).alias("doc_id"), F.xxhash64("text").alias("tie"))
    share = min(1.0, KEYS_PER_PART * parts / max(docs.count(), 1))
    drawn = F.pmod(F.xxhash64("doc_id", "tie", F.lit("range")), F.lit(1 << 30)) < int(share * (1 << 30))
    found = keys.where(drawn).limit(2 * KEYS_PER_PART * parts).toArrow().to_pydict()
    pairs = sorted(zip(found["doc_id"], found["tie"]))
    return np.array([pairs[len(pairs) * i // parts] for i in range(1, parts)] if pairs else [], np.int64).reshape(-1, 2)


def _part_of(keys: np.ndarray, ties: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The range of each (doc_id, tie): how many bounds are not above it."""
    low = np.searchsorted(bounds[:, 0], keys, "left")
    high = np.searchsorted(bounds[:, 0], keys, "right")
    tied = np.flatnonzero(high > low)
    for i in tied:
        high[i] = low[i] + np.searchsorted(bounds[low[i] : high[i], 1], ties[i], "right")
    return high


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int, bounds: np.ndarray) -> DataFrame:
    """doc_id, tie (a digest of the text), part, n_tokens and packed ids, with the end id, of every row.

    For tokenizers that drop white space and take each run of other characters
    by itself, so that distinct words are encoded once per worker.
    """

    def run(batches):
        tokenizer = library_tokenizer(tokenizer_path)
        kind = id_type(max(tokenizer.get_vocab_size(), end_id + 1))
        table = lower_case_pieces(tokenizer_path)
        for batch in batches:
            for start, stop in slices(batch.column("text")):
                part = batch.slice(start, stop - start)
                offsets, codes, known = words(part.column("text"))
                flat, at, counts = table.lookup(known)
                n = row_sums(counts[codes], offsets)
                ends = np.cumsum(n + 1)
                ids = np.full(int(ends[-1]), end_id, kind)
                inside = np.ones(len(ids), bool)
                inside[ends - 1] = False
                ids[inside] = gather(flat, at, counts, codes)
                at = np.concatenate([[0], ends * ids.itemsize]).astype(np.int32)
                data = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(at), pa.py_buffer(ids)])
                keys, ties = part.column("doc_id").to_numpy(zero_copy_only=False), part.column("tie")
                place = _part_of(keys, ties.to_numpy(zero_copy_only=False), bounds)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), ties, pa.array(place, pa.int32()), pa.array(n + 1, pa.int64()), data],
                    ["doc_id", "tie", "part", "n_tokens", "ids"],
                )

    # The digest only orders repeated rows of one document.
    key = F.coalesce("doc_id", F.lit(NO_DOCUMENT_ID)).alias("doc_id")
    keyed = docs.select(key, F.xxhash64("text").alias("tie"), "text")
    return keyed.mapInArrow(run, "doc_id long, tie long, part int, n_tokens long, ids binary")


def file_system(uri: str):
    """(file system, path) of a folder or file that all executors reach."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[len("file:") :].lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str) -> DataFrame:
    """Write ``docs(doc_id, text)`` in ascending doc_id order; the manifest of the parts.

    A part is three files: ids (flat unsigned integers), offsets (64-bit, one
    more than documents, counted in ids from the start of the part) and
    documents (64-bit doc_ids). Each attempt of a task writes files of its own
    name; only those of the attempt that Spark kept are in the manifest, so
    lost executors and retries leave no double rows. Manifest columns: part,
    name, width, n_docs, n_tokens, base (ids of all parts before it, a prefix
    sum).
    """
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def write(batches):
        name, part, n_docs, n_tokens, out, width = f"part-{uuid.uuid4().hex}", 0, 0, 0, None, 0
        try:
            for batch in batches:
                if not len(batch):
                    continue
                if out is None:
                    part = batch.column("part")[0].as_py()
                    where, path = file_system(folder)
                    where.create_dir(path, recursive=True)
                    out = [where.open_output_stream(f"{path}/{name}.{x}") for x in ("ids", "offsets", "documents")]
                    out[1].write(np.zeros(1, "<u8").tobytes())
                sizes = batch.column("n_tokens").to_numpy(zero_copy_only=False)
                width = pc.sum(pc.binary_length(batch.column("ids"))).as_py() // int(sizes.sum())
                for data in batch.column("ids"):
                    out[0].write(data.as_buffer())
                out[1].write((n_tokens + np.cumsum(sizes)).astype("<u8").tobytes())
                out[2].write(batch.column("doc_id").to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                n_docs, n_tokens = n_docs + len(batch), n_tokens + int(sizes.sum())
        finally:
            for stream in out or ():
                stream.close()
        if out is not None:
            yield pa.RecordBatch.from_pylist(
                [{"part": part, "name": name, "width": width, "n_docs": n_docs, "n_tokens": n_tokens}],
                pa.schema([("part", pa.int32()), ("name", pa.string()), ("width", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]),
            )

    # The ranges are known, so the ids are encoded once and shuffled once.
    table = encoded(docs, tokenizer_path, end_id, _bounds(docs, parts))
    ordered = table.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "doc_id", "tie")
    manifest = materialize(
        ordered.select("part", "doc_id", "ids", "n_tokens").mapInArrow(
            write, "part int, name string, width int, n_docs long, n_tokens long"
        ),
        "manifest",
    )
    # One row per written part, so the prefix sum of the bases is as small as the list of tasks.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


class TokenFile:
    """One part, read by offset; memory-mapped where the folder is a local path."""

    def __init__(self, folder: str, name: str, width: int):
        from pyarrow import fs

        self.where, path = file_system(folder)
        self.local, self.stem, self.width = isinstance(self.where, fs.LocalFileSystem), f"{path}/{name}", width
        self.offsets = self._column("offsets", "<u8")
        self.documents = self._column("documents", "<i8")
        if self.local:
            self.mapped = np.memmap(f"{self.stem}.ids", f"<u{width}", "r")

    def _column(self, name: str, kind: str) -> np.ndarray:
        if self.local:
            return np.memmap(f"{self.stem}.{name}", kind, "r")
        with self.where.open_input_stream(f"{self.stem}.{name}") as f:
            return np.frombuffer(f.read(), kind)

    def ids(self, start: int, stop: int) -> np.ndarray:
        if self.local:
            return self.mapped[start:stop]
        with self.where.open_input_file(f"{self.stem}.ids") as f:
            f.seek(start * self.width)
            return np.frombuffer(f.read((stop - start) * self.width), f"<u{self.width}")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (over all parts), n_tokens and ids_crc32 of every document, from the files."""

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                part = TokenFile(folder, row["name"], row["width"])
                n = len(part.documents)
                begin = 0
                while begin < n:
                    # a run of documents of about READ_IDS ids, one document at least
                    first = int(part.offsets[begin])
                    end = int(np.searchsorted(part.offsets, first + READ_IDS, "right")) - 1
                    end = min(max(end, begin + 1), n)
                    at = part.offsets[begin : end + 1].astype(np.int64)
                    data = np.asarray(part.ids(first, int(at[-1]))).astype("<u4").tobytes()
                    spans = zip((at[:-1] - first).tolist(), (at[1:] - first).tolist())
                    keys = np.asarray(part.documents[begin:end])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(keys, mask=keys == NO_DOCUMENT_ID),
                            pa.array(at[:-1] + row["base"], pa.int64()),
                            pa.array(np.diff(at), pa.int64()),
                            pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in spans], pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    begin = end

    # By name, so that the parts spread over tasks although the manifest is small.
    parts = max(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return manifest.repartition(parts, "name").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Write token files of ``docs(doc_id, text)`` and return what reading them back gives.

    A null or empty text is written as the end id alone. Documents stand in
    ascending doc_id order, null ids first; repeated rows of one doc_id follow
    each other in the order of a digest of their text. An empty table gives no
    files and no rows. Other columns are ignored. Without ``folder`` the files
    go to a new one under the session's shared folder.
    """
    folder = folder or f"{shared_dir(docs.sparkSession)}/perilweave/tokens-{uuid.uuid4().hex}"
    return read_token_files(write_token_files(docs, tokenizer_path, end_id, folder), folder)
