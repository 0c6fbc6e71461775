"""Approximate nearest neighbours by inner product: an inverted multi-index."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from perilweave.session import materialize

from .vectors import kmeans, matrix, sample, usable

SAMPLE_ROWS = 8_000
CODES = 16
BLOCK_ROWS = 4096
QUERY_BLOCK = 512
PILOT_QUERIES = 256
PILOT_SEED = 11


class MultiIndex:
    """Two codebooks, one for each half of a vector; a cell is a pair of codes."""

    def __init__(self, drawn: np.ndarray, codes: int = CODES):
        self.half = drawn.shape[1] // 2
        self.books = [kmeans(part, codes) for part in np.split(drawn, [self.half], axis=1)]

    @property
    def cells(self) -> int:
        return len(self.books[0]) * len(self.books[1])

    def cell_of(self, x: np.ndarray) -> np.ndarray:
        """The cell with the nearest centroid in either half."""
        codes = [
            (part @ book.T - (book**2).sum(axis=1) / 2).argmax(axis=1)
            for part, book in zip(np.split(x, [self.half], axis=1), self.books)
        ]
        return codes[0] * len(self.books[1]) + codes[1]

    def traverse(self, query: np.ndarray, counts: np.ndarray, wanted: float):
        """Cells in falling order of the sum of both halves' inner products, until they hold ``wanted`` entries.

        Both halves' centroids are sorted; a heap holds the border of the pairs
        already passed, so the next best pair is always on top.
        """
        near = [book @ part for part, book in zip(np.split(query, [self.half]), self.books)]
        order = [np.argsort(-n, kind="stable") for n in near]
        near = [n[o] for n, o in zip(near, order)]
        width, held, passed = len(self.books[1]), 0, np.zeros((len(order[0]), len(order[1])), bool)
        heap, passed[0, 0] = [(-near[0][0] - near[1][0], 0, 0)], True
        while heap and held < wanted:
            _, i, j = heapq.heappop(heap)
            cell = int(order[0][i]) * width + int(order[1][j])
            held += counts[cell]
            yield cell
            for k, m in ((i + 1, j), (i, j + 1)):
                if k < len(order[0]) and m < len(order[1]) and not passed[k, m]:
                    passed[k, m] = True
                    heapq.heappush(heap, (-near[0][k] - near[1][m], k, m))


def probe_share(index: MultiIndex, drawn: np.ndarray, k: int, recall: float) -> float:
    """The share of entries to visit so that the sample's own neighbours are found.

    PILOT_QUERIES vectors, drawn among the distinct ones of the sample so that a
    group of copies asks once, ask for their k best ones among the sample, copies
    included; the share is where ``recall`` of all of them is reached.
    """
    cells = index.cell_of(drawn)
    counts = np.bincount(cells, minlength=index.cells)
    needed = []
    distinct = np.unique(drawn, axis=0, return_index=True)[1] if len(drawn) else np.zeros(0, np.int64)
    for i in np.random.default_rng(PILOT_SEED).permutation(distinct)[:PILOT_QUERIES]:
        score = drawn @ drawn[i]
        score[i] = -np.inf
        best = np.argpartition(-score, min(k, len(score) - 1))[:k]
        position = np.zeros(index.cells)
        visited = 0
        for cell in index.traverse(drawn[i], counts, np.inf):
            visited += counts[cell]
            position[cell] = visited
        needed.append(position[cells[best]] / len(drawn))
    return float(np.quantile(np.concatenate(needed), recall)) if needed else 1.0


def _best(queries: pa.Table, entries: pa.Table, cells: int, k: int) -> pa.Table:
    """The k best entries of this block for each query, of the cells that it visits."""
    ids, best, scores = [], [], []
    if len(queries) and len(entries):
        q, x = (matrix(t.column("embedding").combine_chunks()) for t in (queries, entries))
        qid, xid, cell = queries.column("query_id").to_numpy(), entries.column("vec_id").to_numpy(), entries.column("cell").to_numpy()
        visits = np.zeros((len(q), cells), bool)
        lists = queries.column("cells").combine_chunks()
        visits[np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()] = True
        near = np.where(visits[:, cell] & (qid[:, None] != xid[None]), q @ x.T, -np.inf)
        for i in range(len(q)):
            row = near[i]
            if len(row) > k:
                # candidates down to the k-th best, with all that could tie with it
                edge = np.partition(row, len(row) - k)[len(row) - k]
                found = np.flatnonzero(row >= max(edge - 1e-9 * (1 + abs(edge)), np.finfo(float).min))
            else:
                found = np.flatnonzero(row > -np.inf)
            exact = (x[found] * q[i]).sum(axis=1)
            top = found[np.lexsort((xid[found], -exact))[:k]]
            ids.append(np.full(len(top), qid[i]))
            best.append(xid[top])
            scores.append((x[top] * q[i]).sum(axis=1))
    join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0), kind)
    return pa.table({"query_id": join(ids, pa.int64()), "vec_id": join(best, pa.int64()), "score": join(scores, pa.float64())})


def nearest_neighbours(
    vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float = 0.97, share: float | None = None
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of ``vectors`` for each row of ``queries``.

    Both tables have vec_id and embedding. Nearness is the inner product in
    double precision, ties go to the smaller vec_id. Vectors that are null,
    zero or hold null or non-finite components, and rows with a null vec_id,
    take no part; a query's own vec_id never answers it, and repeated rows of
    an id count once. A query has fewer rows only if the cells it visits hold
    fewer entries, which cannot be while the table holds k. Empty tables give no rows.

    Codebooks are fitted on a sample of about SAMPLE_ROWS rows; every row is in
    the index. A query walks the pairs of centroids until it has seen ``share``
    of the entries and at least 4 k of them; without ``share`` it is measured on
    the sample for the wished recall. Queries go in blocks, entries in blocks
    of cells, so every product is a bounded matrix product and no query meets
    cells that its block does not visit.
    """
    columns = lambda df: df.where(usable("embedding") & F.col("vec_id").isNotNull()).select("vec_id", "embedding")
    entries = columns(vectors)
    empty = "query_id long, rank int, vec_id long, score double"
    drawn = sample(entries, "embedding", SAMPLE_ROWS, "vec_id")
    if not len(drawn):
        return vectors.sparkSession.createDataFrame([], empty)
    index = MultiIndex(drawn)
    share = share or probe_share(index, drawn, k, recall)

    def indexed(batches):
        for batch in batches:
            cell = pa.array(index.cell_of(matrix(batch.column("embedding"))), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, cell], ["vec_id", "embedding", "cell"])

    kind = vectors.schema["embedding"].dataType.simpleString()
    entries = entries.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    entries = materialize(entries.mapInArrow(indexed, f"vec_id long, embedding {kind}, cell int"), "entries")
    held = entries.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).toPandas()  # CODES squared rows at most
    counts = np.zeros(index.cells, np.int64)
    counts[held.cell] = held.n
    wanted = max(share * counts.sum(), 4 * k + 1)

    def walked(batches):
        for batch in batches:
            cells = [list(index.traverse(q, counts, wanted)) for q in matrix(batch.column("embedding"))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cells, pa.list_(pa.int32()))], ["query_id", "embedding", "cells"]
            )

    asked = columns(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = asked.mapInArrow(walked, f"query_id long, embedding {kind}, cells array<int>")
    asked = materialize(asked, "queries")
    blocks = -(-asked.count() // QUERY_BLOCK)
    if not blocks:
        return vectors.sparkSession.createDataFrame([], empty)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    visited = asked.select("block", F.explode("cells").alias("cell")).distinct()
    pieces = [-(-int(n) // BLOCK_ROWS) for n in counts]
    groups, group = np.zeros(len(counts), np.int64), 0
    filled = 0
    for cell, n in enumerate(counts):
        # neighbouring cells share a block of entries as long as it has room
        if filled and filled + n > BLOCK_ROWS:
            group, filled = group + 1, 0
        groups[cell], filled = group, filled + int(n)
    layout = F.array(*[F.struct(F.lit(int(g)).alias("g"), F.lit(max(p, 1)).alias("p")) for g, p in zip(groups, pieces)])
    place = layout[F.col("cell")]
    piece = F.pmod(F.xxhash64("vec_id"), place["p"]).cast("int")
    right = entries.join(visited, "cell").select(
        "block", place["g"].cast("int").alias("group"), piece.alias("piece"), "vec_id", "embedding", "cell"
    )
    dealt = F.explode(F.array_distinct(F.flatten(F.transform("cells", lambda c: F.transform(
        F.sequence(F.lit(0), layout[c]["p"] - 1), lambda p: F.struct(layout[c]["g"].cast("int").alias("group"), p.cast("int").alias("piece"))
    )))))
    left = asked.select("block", dealt.alias("at"), "query_id", "embedding", "cells").select(
        "block", "at.group", "at.piece", "query_id", "embedding", "cells"
    )
    cells, place, names = index.cells, ["block", "group", "piece"], right.columns
    right = right.toDF(*[f"entry_{c}" for c in names])
    found = (
        left.groupBy(*place)
        .cogroup(right.groupBy(*[f"entry_{c}" for c in place]))
        .applyInArrow(
            lambda a, b: _best(a, b.rename_columns(names), cells, k), "query_id long, vec_id long, score double"
        )
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )
