"""Connected components by randomised contraction, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilweave.session import materialize

ROWS_PER_TASK = 400_000


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links(a, b)``; component is the smallest node.

    Each round every node points to the neighbour (or itself) with the smallest
    random priority, and the graph is rewritten between those targets, which
    shrinks any shape, long chains too, by a constant factor on average. All
    work is aggregations with map-side combine and equi-joins that adaptive
    execution can split; nothing is gathered per component. Tables are written
    by as many tasks as their links need.
    """
    edges = materialize(
        links.where("a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    steps, left_over = [], edges.count()
    while not steps or left_over:
        tasks = left_over // ROWS_PER_TASK + 1
        both = edges.union(edges.select("b", "a"))
        # The same priorities in every round: the middle of a star, once small, stays so.
        rank = lambda c: F.struct(F.xxhash64(c).alias("p"), F.col(c).alias("n"))
        pointer = both.groupBy("a").agg(F.min(rank("b")).alias("best"))
        pointer = materialize(
            pointer.select(
                F.col("a").alias("node"), F.least(rank("a"), F.col("best"))["n"].alias("target")
            ).coalesce(tasks),
            "pointers",
        )
        steps.append(pointer)
        left = pointer.select(F.col("node").alias("a"), F.col("target").alias("ta"))
        right = pointer.select(F.col("node").alias("b"), F.col("target").alias("tb"))
        edges = materialize(
            edges.join(left, "a")
            .join(right, "b")
            .where("ta <> tb")
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
            .distinct()
            .coalesce(tasks),
            "edges",
        )
        left_over = edges.count()
    roots = steps[0]
    tasks = roots.count() // ROWS_PER_TASK + 1
    for step in steps[1:]:
        step = step.select(F.col("node").alias("target"), F.col("target").alias("next"))
        roots = roots.join(step, "target", "left").select(
            "node", F.coalesce("next", "target").alias("target")
        )
    roots = materialize(roots.coalesce(tasks), "roots")
    smallest = roots.groupBy("target").agg(F.min("node").alias("component"))
    return roots.join(smallest, "target").select("node", "component").coalesce(tasks)


def joined_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes(node, component)`` after further ``links(a, b)``; only components that links meet are looked at again."""
    named = lambda c, out: nodes.select(F.col("node").alias(c), F.col("component").alias(out))
    met = links.join(named("a", "ca"), "a", "left").join(named("b", "cb"), "b", "left")
    met = materialize(
        met.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")), "met"
    )
    over = connected_components(met.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    over = materialize(over.select(F.col("node").alias("component"), F.col("component").alias("whole")), "whole")
    fresh = met.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    fresh = fresh.join(nodes, "node", "left_anti").select("node", F.col("node").alias("component"))
    return nodes.union(fresh).join(over, "component", "left").select(
        "node", F.coalesce("whole", "component").alias("component")
    )
