"""The Merkle manifest against trees built in one process."""

import random
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from perilweave.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf int, index string, n int"


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(row, changed=False):
    values = list(row[:5])
    if changed and values[3] is not None:
        values[3] += 1
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h("".join(below[i : i + 2])) for i in range(0, len(below), 2)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        j = i ^ 1
        out.append(None if j >= len(level) else (j < i, level[j]))
        i >>= 1
    return out


def in_one_process(rows, tampered):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = tree([leaf(r) for r in by[lang]])
    if not rows:
        return []
    top = tree([trees[lang][-1][0] for lang in langs])
    root, out = top[-1][0], []
    for k, lang in enumerate(langs):
        for i, r in enumerate(by[lang]):
            steps = path(trees[lang], i) + path(top, k)
            x = leaf(r, tampered(r))
            for s in steps:
                x = h(x) if s is None else h(s[1] + x if s[0] else x + s[1])
            proof = h("".join(s[1] for s in steps if s))
            out.append((r[0], leaf(r), trees[lang][-1][0], root, proof, x, x == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("n, span", [(0, 1), (1, 10), (2, 3), (3000, 10**6), (2500, 2**62), (2600, 500)])
def test_equals_trees_built_in_one_process(spark, n, span):
    rnd = random.Random(n + span)
    rows = [
        (
            rnd.choice([rnd.randrange(-span, span)] * 20 + [None]), rnd.choice(["a", "é", None]),
            rnd.choice(["de"] * (20 if n > 100 else 1) + ["en", None, "ü", ""]), rnd.choice([None, rnd.randrange(10**6), 2]),
            rnd.choice([None, "", "x" * rnd.randrange(30), "日本", "w " * 40_000 if n < 100 else "-"]), 1, "clash", None,
        )
        for _ in range(n)
    ]
    rows += rows[:7] * 2  # repeated rows have a place and a proof each
    df = spark.createDataFrame(rows, SCHEMA).repartition(5) if rows else spark.createDataFrame([], SCHEMA)
    got = manifest.manifest(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    changed = lambda r: r[0] is not None and crc32(str(r[0]).encode()) % 7 == 0
    assert sorted(map(tuple, got.collect()), key=repr) == in_one_process(rows, changed)


def test_without_tampering_every_row_verifies(spark):
    df = spark.range(700).selectExpr("id AS doc_id", "'s' AS source", "CAST(NULL AS STRING) AS lang", "id AS n_chars", "'t' AS text")
    assert manifest.manifest(df).where("not verified").isEmpty()


def test_ranks_follow_an_order_by_hand_with_many_rows_of_one_id(spark):
    ids = [None] * 300 + [5] * 900 + list(range(-2000, 2000, 3)) + [2**61, -(2**61)]
    rows = [("=x", i, f"{n % 50:02d}".encode(), n) for n, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "tree string, doc_id long, leaf binary, row long").repartition(6)
    got = {r.row: (r["index"], r.n) for r in manifest.ranked(df).collect()}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    assert got == {r[3]: (place, len(rows)) for place, r in enumerate(order)}


def test_ranks_use_equi_joins_only(spark, capsys):
    df = spark.createDataFrame([("=x", 1, b"a", 0)], "tree string, doc_id long, leaf binary, row long")
    manifest.ranked(df).explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan
