"""Near-duplicate vectors: spherical k-means cells and blocked cosine products."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilweave.session import materialize

from .components import connected_components
from .vectors import matrix, sample, spherical_kmeans, usable

SAMPLE_ROWS = 8_000
MOST_CELLS = 1024
ROWS_PER_CELL = 4096
BLOCK_ROWS = 2048


def _placed(groups: DataFrame, centres: np.ndarray, threshold: float) -> DataFrame:
    """``groups`` with the cell of every vector (home) and the cells it visits.

    A vector visits each cell that can hold one whose cosine with it reaches
    the threshold: unit vectors that close lie at most sqrt(2 - 2 * threshold)
    apart, so the plane between the two cells must not be farther away.
    """
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0))

    def run(batches):
        for batch in batches:
            x = matrix(batch.column("embedding"))
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            near = unit @ centres.T
            home = near.argmax(axis=1)
            lead = near[np.arange(len(x)), home][:, None] - near
            meets = lead <= reach * apart[home] + 1e-9
            meets[np.arange(len(x)), home] = True
            _, cell = np.nonzero(meets)
            ends = np.concatenate([[0], np.cumsum(meets.sum(axis=1))])
            cells = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(cell, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(home, pa.int32()), cells], [*batch.schema.names, "home", "cells"]
            )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in groups.schema)
    return groups.mapInArrow(run, f"{kinds}, home int, cells array<int>")


def _compared(left: pa.Table, right: pa.Table, threshold: float) -> pa.Table:
    """Per vector its links from left to right, and the components that they form here.

    Rows are (key, anchor, n): n links of a vector on the left, and an anchor in
    the same component, so a block returns no more rows than it has vectors.
    """
    key, anchor, links = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(left) and len(right):
        a, b = left.column("key").to_numpy(), right.column("key").to_numpy()
        x, y = (matrix(t.column("embedding").combine_chunks()) for t in (left, right))
        x, y = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, y))
        near = (x @ y.T >= threshold) & (a[:, None] != b[None])
        rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        near = near[np.ix_(rows, columns)]
        a, b, far = a[rows], b[columns], np.iinfo(np.int64).max
        of_a, of_b = a.copy(), b.copy()
        while len(rows):
            # smallest key over the links, to and fro, until nothing changes
            new_a = np.minimum(of_a, np.where(near, of_b[None], far).min(axis=1))
            new_b = np.minimum(of_b, np.where(near, new_a[:, None], far).min(axis=0))
            same = (new_a == of_a).all() and (new_b == of_b).all()
            of_a, of_b = new_a, new_b
            if same:
                break
        key += [a, b]
        anchor += [of_a, of_b]
        links += [near @ right.column("copies").to_numpy()[columns], np.zeros(len(b), np.int64)]
    return pa.table({"key": np.concatenate(key), "anchor": np.concatenate(anchor), "n": np.concatenate(links)})


def near_duplicates(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors(vec_id, embedding, label)``.

    Vectors are linked when their labels are equal and not null and their cosine,
    in double precision, is at least ``threshold``. A vector that is null, zero
    or holds null or non-finite components, or whose vec_id is null, is linked
    with nothing: 0 links, its own component. Equal vectors of one label are one
    vector with copies, each linked with the others; repeated rows are such
    copies. An empty table gives no rows; other columns are ignored.

    Cells come from spherical k-means on a sample of about SAMPLE_ROWS vectors;
    every vector is compared with all members of its own cell and of each cell
    that can hold a partner, so none is lost. Cells are dealt to blocks of about
    BLOCK_ROWS; a block returns counts and component anchors, never pairs.
    """
    rows = vectors.select("vec_id", "label", "embedding")
    fit = usable("embedding") & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    groups = (
        rows.where(fit)
        .groupBy("label", "embedding")
        .agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
        .withColumn("key", F.xxhash64("label", "embedding"))
    )
    groups = materialize(groups, "vectors")
    drawn = sample(groups, "embedding", SAMPLE_ROWS, "first_id")
    if not len(drawn):
        return rows.select(
            "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
            F.col("vec_id").isNotNull().alias("kept"),
        )
    cells = min(MOST_CELLS, max(1, groups.count() // ROWS_PER_CELL))
    placed = materialize(_placed(groups, spherical_kmeans(drawn, cells), threshold), "placed")

    members = placed.select("label", F.col("home").alias("cell"), "key", "copies", "embedding")
    visitors = placed.select("label", F.explode("cells").alias("cell"), "key", "copies", "embedding")
    blocks = lambda n: F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias(n)
    plan = members.groupBy("label", "cell").agg(blocks("member_blocks"))
    plan = plan.join(visitors.groupBy("label", "cell").agg(blocks("visitor_blocks")), ["label", "cell"])
    plan = materialize(plan, "blocks")

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        mine, theirs = f"{own}_block", f"{other}_block"
        number = F.pmod(F.xxhash64("key", F.lit(own)), F.col(f"{own}_blocks")).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1))
        return side.join(plan, ["label", "cell"]).select(
            "label", "cell", number.alias(mine), every.alias(theirs), "key", "copies", "embedding"
        )

    place = ["label", "cell", "visitor_block", "member_block"]
    left, right = dealt(visitors, "visitor", "member"), dealt(members, "member", "visitor")
    names = right.columns
    right = right.toDF(*[f"other_{c}" for c in names])
    found = (
        left.groupBy(*place)
        .cogroup(right.groupBy(*[f"other_{c}" for c in place]))
        .applyInArrow(lambda a, b: _compared(a, b.rename_columns(names), threshold), "key long, anchor long, n long")
    )
    found = materialize(found, "compared")
    counts = found.groupBy("key").agg(F.sum("n").alias("n"))
    parts = connected_components(found.select(F.col("key").alias("a"), F.col("anchor").alias("b")))
    of_key = groups.select("key", "first_id", "copies").join(counts, "key", "left")
    of_key = of_key.join(parts.withColumnRenamed("node", "key"), "key", "left")
    of_key = materialize(of_key.withColumn("root", F.coalesce("component", "key")), "keys")
    named = of_key.groupBy("root").agg(F.min("first_id").alias("component_id"))
    links = F.col("copies") - 1 + F.coalesce("n", F.lit(0))
    of_key = of_key.join(named, "root").select("key", links.alias("n_links"), "component_id")
    keyed = rows.select("vec_id", F.when(fit, F.xxhash64("label", "embedding")).alias("key"))
    component = F.coalesce("component_id", "vec_id")
    return keyed.join(of_key, "key", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
