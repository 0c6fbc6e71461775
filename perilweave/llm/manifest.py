"""Merkle manifest of a dataset: one tree a group, one over the groups, and a proof for every row.

A leaf's place in its group's tree is its rank by doc_id. Ranks come from
bitmaps of the doc_ids and a directory of their bit counts, so no row is sorted
to find its place; nodes are then put into slot arrays by their place, each of
which reduces ten levels of the tree at once.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from perilweave.session import materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
WORD_BITS = 6  # doc_ids that share a word of the bitmap
FAN_BITS = 10  # words or nodes that share an entry one level up the directory
SLOT_BITS = 10  # levels of the tree that a slot array reduces
RESULT = (
    "doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
    "folded_root string, verified boolean"
)


# ---------------------------------------------------------------- leaves


def leaf_digest(columns: dict[str, Column]) -> Column:
    """sha256 (binary) of the values, each ``-`` if null, else its UTF-8 byte count, ``:`` and itself."""

    def part(c: Column) -> Column:
        shown = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*map(part, columns.values())), 256))


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """row, doc_id, tree, leaf of every document, and the leaf that tampering makes of it (null if untouched).

    Tampering adds 1 to n_chars; a null stays null, the largest long as it is.
    ``tree`` names the group and sorts as lang does, null first.
    """
    own = {c: F.col(c) for c in FIELDS}
    changed = own | {"n_chars": F.coalesce(F.try_add("n_chars", F.lit(1)), "n_chars")}
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("tree"),
        leaf_digest(own).alias("leaf"),
        F.when(tampered, leaf_digest(changed)).alias("tampered"),
    )


# ---------------------------------------------------------------- ranks


def ordinals(df: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """Add the 0-based place of each row within its group in the given order (nulls first).

    Ranges of rows are sorted apart and written once; a group may reach over
    any number of them, and only its counts by range meet.
    """
    keys = [*group, *order]
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    placed = materialize(ranged.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    placed = placed.withColumn("_range", F.shiftright("_at", 33))
    runs = placed.groupBy(*group, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*group, "_range", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.join(runs, [*group, "_range"]).select(
        *df.columns, (F.col("_start") + F.col("_at") - F.col("_first")).alias(out)
    )


def bitmap(found: DataFrame) -> DataFrame:
    """tree, word, bits, n: words of 64 doc_ids that any row of a tree has, and how many rows have them.

    Empty words are not stored. Rows without a doc_id are counted under a null word.
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("doc_id").bitwiseAND(63).cast("int"))
    return found.groupBy("tree", F.shiftright("doc_id", WORD_BITS).alias("word")).agg(
        F.bit_or(bit).alias("bits"), F.count(F.lit(1)).alias("n")
    )


def directory(words: DataFrame) -> DataFrame:
    """``bitmap`` with ``start``, the rank of a word's first row, and ``size``, the rows of the tree.

    Counts are added up by common upper digits of the word's number, level by
    level, until a tree has one level of few entries; starts come down the same
    way, from prefix sums over the at most 2^FAN_BITS entries under one upper
    entry. Rows without a doc_id come first.
    """
    trees = words.groupBy("tree").agg(
        F.sum("n").alias("size"), F.sum(F.when(F.col("word").isNull(), F.col("n")).otherwise(0)).alias("nulls")
    )
    ends = words.agg(F.min("word").alias("low"), F.max("word").alias("high")).first()
    levels = [words.where("word is not null").withColumnRenamed("word", "node")]
    low, high = (0, 0) if ends.low is None else (ends.low, ends.high)
    while high - low >= 1 << FAN_BITS:
        low, high = low >> FAN_BITS, high >> FAN_BITS
        up = levels[-1].groupBy("tree", F.shiftright("node", FAN_BITS).alias("node")).agg(F.sum("n").alias("n"))
        levels.append(materialize(up, "directory"))

    def before(*key: str) -> Column:
        window = Window.partitionBy("tree", *key).orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(window), F.lit(0))

    top = levels.pop()
    started = top.join(trees, "tree").withColumn("start", before() + F.col("nulls"))
    while levels:
        upper = started.select("tree", F.col("node").alias("upper"), "start", "size")
        lower = levels.pop().withColumn("upper", F.shiftright("node", FAN_BITS))
        lower = lower.withColumn("within", before("upper"))
        started = lower.join(upper, ["tree", "upper"]).withColumn("start", F.col("start") + F.col("within"))
    lone = words.where("word is null").join(trees, "tree").select("tree", "word", "bits", "n", F.lit(0).cast("long").alias("start"), "size")
    return started.select("tree", F.col("node").alias("word"), "bits", "n", "start", "size").union(lone)


def ranked(found: DataFrame) -> DataFrame:
    """``leaves`` with ``index`` (place in the tree) and ``n`` (rows of the tree).

    The place is the start of the row's word and the bits below its own. Words
    in which some doc_id has several rows count their rows one doc_id at a time;
    rows of one doc_id follow each other by leaf, and equal leaves in any order.
    """
    words = materialize(bitmap(found), "bitmap")
    known = materialize(directory(words), "starts").withColumns(
        {"_word": F.coalesce("word", F.lit(0)), "_none": F.col("word").isNull()}
    )
    rows = found.withColumns(
        {
            "_word": F.coalesce(F.shiftright("doc_id", WORD_BITS), F.lit(0)),
            "_none": F.col("doc_id").isNull(),
            "_below": F.bitwise_not(
                F.call_function("shiftleft", F.lit(-1).cast("long"), F.col("doc_id").bitwiseAND(63).cast("int"))
            ),
        }
    )
    columns = [*found.columns, "index", F.col("size").alias("n")]
    plain = F.col("n") == F.coalesce(F.bit_count("bits"), F.lit(0))
    met = rows.join(known, ["tree", "_none", "_word"])
    single = met.where(plain).withColumn("index", F.col("start") + F.bit_count(F.col("bits").bitwiseAND(F.col("_below"))))
    if known.where(~plain).isEmpty():
        return single.select(*columns)
    several = met.where(~plain).withColumn("_id", F.coalesce("doc_id", F.lit(0)))
    key = ["tree", "_none", "_id"]
    ids = several.groupBy(*key, "_word", "start").agg(F.count(F.lit(1)).alias("_rows"))
    within = Window.partitionBy("tree", "_none", "_word").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    ids = ids.select(*key, (F.col("start") + F.coalesce(F.sum("_rows").over(within), F.lit(0))).alias("_from"))
    among = ordinals(several.select(*found.columns, "_none", "_id", "size"), key, ["leaf", "row"], "_nth")
    among = among.join(ids, key).withColumn("index", F.col("_from") + F.col("_nth"))
    return single.select(*columns).union(among.select(*columns))


# ---------------------------------------------------------------- trees


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def reduced(nodes: list[str], steps: int) -> list[list[str]]:
    """The levels above ``nodes``: every two neighbours, or a last one alone, become their digest."""
    levels = [nodes]
    for _ in range(steps):
        below = levels[-1]
        levels.append([digest("".join(below[i : i + 2])) for i in range(0, len(below), 2)])
    return levels


def steps_of(nodes: int) -> int:
    """Levels that a slot array of a tree with so many nodes goes up."""
    return min(SLOT_BITS, (nodes - 1).bit_length())


def siblings(levels: list[list[str]], slot: int) -> list[str]:
    """On each level but the last the other node of the pair, marked L or R by its side; ``-`` if there is none."""
    out = []
    for level in levels[:-1]:
        other = slot ^ 1
        out.append("-" if other >= len(level) else ("L" if other < slot else "R") + level[other])
        slot >>= 1
    return out


def folded(leaf: str, path: list[str]) -> str:
    """The root that a leaf and the siblings on its path give."""
    for step in path:
        other = step[1:]
        leaf = digest(other + leaf if step[0] == "L" else leaf + other)
    return leaf


def _slots(table: pa.Table, column: str) -> list:
    """The slot array of one group: values at the places their index names."""
    index, values = table.column("index").to_pylist(), table.column(column).to_pylist()
    out = [None] * len(index)
    for i, v in zip(index, values):
        out[i & (1 << SLOT_BITS) - 1] = v
    return out


def _levels(table: pa.Table) -> list[list[str]]:
    return reduced([x.hex() for x in _slots(table, "node")], steps_of(table.column("n")[0].as_py()))


def climb(nodes: DataFrame, largest: int) -> tuple[list[DataFrame], DataFrame]:
    """(tables of nodes by stage, one node a tree) from ``nodes(tree, index, n, node)``.

    A slot array holds at most 2^SLOT_BITS nodes, so a stage leaves about a
    thousandth of them, however the rows are dealt over trees.
    """
    stages = []

    def up(key, table):
        tree, block = (k.as_py() for k in key)
        n = -(-table.column("n")[0].as_py() >> SLOT_BITS)
        return pa.table(
            {"tree": [tree], "index": [block], "n": [n], "node": [bytes.fromhex(_levels(table)[-1][0])]},
            pa.schema([("tree", pa.string()), ("index", pa.int64()), ("n", pa.int64()), ("node", pa.binary())]),
        )

    while largest > 1:
        stages.append(nodes.withColumn("block", F.shiftright("index", SLOT_BITS)))
        nodes = materialize(
            stages[-1].select("tree", "block", "index", "n", "node").groupBy("tree", "block")
            .applyInArrow(up, "tree string, index long, n long, node binary"), "nodes",
        )
        largest = -(-largest >> SLOT_BITS)
    return stages, nodes


def descend(stages: list[DataFrame], paths: DataFrame) -> DataFrame:
    """Paths of the lowest stage's slot arrays: ``paths(tree, block, path, subroot, root)`` taken down the stages."""

    def down(key, nodes, above):
        if not nodes.num_rows or not above.num_rows:
            return pa.table({c: pa.array([], t) for c, t in PATH_TYPES})
        levels, rest = _levels(nodes), {c: above.column(c)[0].as_py() for c in ("tree", "path", "subroot", "root")}
        first, count = key[1].as_py() << SLOT_BITS, len(levels[0])
        return pa.table(
            [
                [rest["tree"]] * count,
                [first + i for i in range(count)],
                [siblings(levels, i) + rest["path"] for i in range(count)],
                [rest["subroot"]] * count,
                [rest["root"]] * count,
            ],
            pa.schema(PATH_TYPES),
        )

    for nodes in reversed(stages):
        below = nodes.select("tree", "block", "index", "n", "node").groupBy("tree", "block").cogroup(paths.groupBy("tree", "block"))
        paths = below.applyInArrow(down, PATH_SCHEMA)
    return paths


PATH_TYPES = [("tree", pa.string()), ("block", pa.int64()), ("path", pa.list_(pa.string())), ("subroot", pa.string()), ("root", pa.string())]
PATH_SCHEMA = "tree string, block long, path array<string>, subroot string, root string"


def _proofs(key, nodes, above):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    types = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
    if not nodes.num_rows or not above.num_rows:
        return pa.table({c: pa.array([], t) for c, t in zip(names, types)})
    upper, subroot, root = (above.column(c)[0].as_py() for c in ("path", "subroot", "root"))
    levels, ids, changed = _levels(nodes), _slots(nodes, "doc_id"), _slots(nodes, "tampered")
    proofs, roots = [], []
    for i, leaf in enumerate(levels[0]):
        path = siblings(levels, i) + upper
        proofs.append(digest("".join(step[1:] for step in path)))
        roots.append(folded(changed[i].hex() if changed[i] is not None else leaf, path))
    n = len(ids)
    columns = [ids, levels[0], [subroot] * n, [root] * n, proofs, roots, [x == root for x in roots]]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names)


# ---------------------------------------------------------------- operator


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of ``docs``.

    ``docs(doc_id, source, lang, n_chars, text)``; other columns are ignored.
    Every lang (null is one too, and comes first) has a tree over its rows by
    doc_id, null first; repeated doc_ids follow each other by leaf, repeated
    rows in any order, each with a place and a proof of its own. The roots of
    the langs, in order of their bytes, are the leaves of the last tree.
    ``folded_root`` folds the original siblings onto the leaf, or onto the one
    that tampering (adding 1 to n_chars, where ``tampered`` holds) makes of it;
    ``verified`` says whether that gives the root. Null fields have a digest of
    their own, texts of any length are digested whole, and an empty table has
    an empty manifest.
    """
    spark = docs.sparkSession
    found = materialize(leaves(docs, F.lit(False) if tampered is None else tampered), "leaves")
    placed = materialize(ranked(found).withColumnRenamed("leaf", "node"), "places")
    largest = placed.agg(F.max("n").alias("n")).first().n
    if not largest:
        return spark.createDataFrame([], RESULT)
    stages, tops = climb(placed.select("tree", "index", "n", "node"), largest)
    tops = tops.select(F.lit("").alias("all"), F.col("tree").alias("name"), "node")
    ordered = materialize(ordinals(tops, ["all"], ["name"], "index"), "subroots")
    trees = ordered.count()
    over = ordered.select(F.col("all").alias("tree"), "index", F.lit(trees).cast("long").alias("n"), "node")
    upper, root = climb(over, trees)
    whole = root.select(
        "tree", F.lit(0).cast("long").alias("block"), F.array().cast("array<string>").alias("path"),
        F.lower(F.hex("node")).alias("subroot"), F.lower(F.hex("node")).alias("root"),
    )
    # Paths of the subroots, then of the slot arrays of their trees.
    paths = descend(upper, whole).select(F.col("block").alias("index"), "path", "root")
    paths = ordered.join(paths, "index").select(
        F.col("name").alias("tree"), F.lit(0).cast("long").alias("block"), "path",
        F.lower(F.hex("node")).alias("subroot"), "root",
    )
    paths = materialize(descend(stages[1:], paths), "paths")
    rows = placed.withColumn("block", F.shiftright("index", SLOT_BITS))
    rows = rows.select("tree", "block", "index", "n", "node", "doc_id", "tampered")
    return rows.groupBy("tree", "block").cogroup(paths.groupBy("tree", "block")).applyInArrow(_proofs, RESULT)
