"""Similarity joins, nearest neighbours and mixing against brute force."""

import re
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from perilweave.llm import components, embedding_dedup, jaccard_join, mixing, nearest_neighbours


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_rings(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(100, 100 + i) for i in range(1, 40)]
    ring = [(200 + i, 200 + (i + 7) % 30) for i in range(30)]
    links = chain + star + ring + [(300, 300), (5, 4)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots({n for e in links for n in e}, links)
    assert got == {n: c for n, c in want.items() if n != 300}
    assert not components.connected_components(spark.createDataFrame([], "a long, b long")).collect()


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


@pytest.mark.parametrize("n, threshold, steps", [(3, Fraction(9, 10), 3), (5, Fraction(4, 5), 1)])
def test_jaccard_components_lose_no_link(spark, n, threshold, steps):
    draw = np.random.default_rng(n)
    rows, key = [], 0
    for size in (1, 2, 3, 6, 9, 12, 20, 31, 60, 120, 400):
        base = [f"w{x}" for x in draw.integers(0, 5000, size)]
        for edits in (0, 0, 1, 1, 2, 3, 5, 8, 13):
            words = list(base)
            for _ in range(min(edits, size)):
                words[draw.integers(0, size)] = f"E{draw.integers(0, 50)}"
            rows.append((key, " ".join(words).title() if edits == 0 else "  ".join(words)))
            key += 1
    common = [f"c{i}" for i in range(60)]
    rows += [(key + i, " ".join([f"u{i}x{j}" for j in range(40)] + common)) for i in range(30)]
    key += 30
    rows += [(key, None), (key + 1, ""), (key + 2, " \n"), (key + 3, "one"), (key + 4, "ONE\t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as set_key", "'x' as component_id").repartition(5)
    sets = {i: shingles(t, n) for i, t in rows}
    links = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])
    ]
    want = {i: (len(sets[i]), c) for i, c in roots(sets, links).items()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, n, threshold, steps).collect()}
    assert got == want
    kept = jaccard_join.representatives(docs, n, threshold, steps)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()})


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 400), st.data(), st.sampled_from([(Fraction(9, 10), 3), (Fraction(4, 5), 2), (Fraction(4, 5), 1)]))
def test_similar_sets_share_a_signature(size, data, kind):
    threshold, steps = kind
    draw = np.random.default_rng(data.draw(st.integers(0, 2**32)))
    a = np.unique(draw.integers(0, 2**63, size, dtype=np.uint64))
    most = int((1 - threshold) * len(a))
    drop, extra = draw.integers(0, most + 1), draw.integers(0, most + 1)
    b = np.unique(np.concatenate([a[drop:], draw.integers(0, 2**63, extra, dtype=np.uint64)]))
    if not len(b) or len(np.intersect1d(a, b)) < threshold * len(np.union1d(a, b)):
        return
    values, offsets = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
    row, sig = jaccard_join.signatures(values, offsets, jaccard_join.Bands(threshold, steps))
    assert set(sig[row == 0]) & set(sig[row == 1])


@pytest.mark.parametrize("block", [7, 512])
def test_blocks_settle_what_hubs_leave_apart(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", block)
    draw, base = np.random.default_rng(4), [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        words = list(base)
        for j in draw.integers(0, 60, 3):
            words[j] = f"x{draw.integers(0, 9)}"
        rows.append((i, " ".join(words)))
    sets = {i: shingles(t, 3) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs, 3, Fraction(4, 5)).collect()}
    assert got == roots(sets, links)


def test_jaccard_edge_cases(spark):
    long = " ".join(f"v{i % 4000}" for i in range(60_000))
    rows = [(None, "a b c d e f"), (None, "only here"), (4, "a b c d e f"), (4, "a b c d e f"), (9, long), (8, long + " end"), (3, "only there")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard_join.jaccard_components(docs, 3, Fraction(9, 10), 3).collect()
    shown = sorted(((r.doc_id, r.component_id) for r in got), key=repr)
    assert shown == sorted([(None, 4), (None, None), (4, 4), (4, 4), (9, 8), (8, 8), (3, 3)], key=repr)
    kept = sorted((r.doc_id for r in jaccard_join.representatives(docs, 3, Fraction(9, 10), 3).collect()), key=repr)
    assert kept == sorted([None, 4, 8, 3], key=repr)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.jaccard_components(empty).isEmpty() and jaccard_join.representatives(empty).isEmpty()


def vectors_of(spark, matrix, labels):
    rows = [(i, [float(x) for x in v], label) for i, (v, label) in enumerate(zip(matrix, labels))]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 8, 1), (n + 2, [float("nan")] + [1.0] * 7, 1), (n + 3, [None] + [1.0] * 7, 1)]
    rows += [(n + 4, rows[0][1], None), (n + 5, rows[0][1], rows[0][2]), (n + 5, rows[0][1], rows[0][2]), (n + 6, [float("inf")] + [1.0] * 7, 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "9 as n_links").repartition(4)


def test_near_duplicate_vectors(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "ROWS_PER_CELL", 20)
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", 16)
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(25, 8))
    matrix = np.float32(np.repeat(centres, 6, axis=0) + draw.normal(size=(150, 8)) * 0.12)
    table = vectors_of(spark, matrix, draw.integers(0, 2, 150).tolist())
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    fit = [
        (i, np.array(v, float), k) for i, v, k in rows
        if k is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)
    ]
    links, count = [], defaultdict(int)
    for x, (i, v, k) in enumerate(fit):
        for y, (j, w, m) in enumerate(fit):
            if x != y and k == m and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
                links.append((i, j))
                count[x] += 1
    want_roots = roots({i for i, _, _ in rows}, links)
    by_id = {fit[x][0]: n for x, n in count.items()}
    got = embedding_dedup.near_duplicates(table).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_links, r.component_id, r.kept) == (by_id.get(r.vec_id, 0), want_roots[r.vec_id], r.vec_id == want_roots[r.vec_id])
    none = table.where("false")
    assert not embedding_dedup.near_duplicates(none).collect()


def test_nearest_neighbours_recall_and_order(spark, monkeypatch):
    monkeypatch.setattr(nearest_neighbours, "BLOCK_ROWS", 64)
    monkeypatch.setattr(nearest_neighbours, "QUERY_BLOCK", 8)
    draw = np.random.default_rng(2)
    matrix = np.float32(draw.normal(size=(600, 8)))
    matrix[50:60] = matrix[49]
    table = vectors_of(spark, matrix, [0] * 600)
    queries = table.where("vec_id % 20 = 0")
    usable = {r.vec_id: np.array(r.embedding, float) for r in table.collect() if r.embedding and None not in r.embedding and np.isfinite(r.embedding).all() and np.any(r.embedding)}
    ids, x = np.array(list(usable)), np.array(list(usable.values()))
    exact = {}
    for q in ids[ids % 20 == 0]:
        score = x @ usable[q]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:20]
        exact[q] = [int(ids[i]) for i in order]
    got = defaultdict(list)
    for r in sorted(nearest_neighbours.nearest_neighbours(table, queries).collect()):
        assert abs(r.score - usable[r.query_id] @ usable[r.vec_id]) < 1e-9
        got[r.query_id].append(r.vec_id)
    assert set(got) == set(exact) and all(len(v) == 20 for v in got.values())
    assert sum(len(set(got[q]) & set(exact[q])) for q in exact) >= 0.9 * 20 * len(exact)
    whole = defaultdict(list)
    for r in sorted(nearest_neighbours.nearest_neighbours(table, queries, share=1.0).collect()):
        whole[r.query_id].append(r.vec_id)
    assert whole == exact
    few = table.where("vec_id in (0, 1, 2)")
    assert nearest_neighbours.nearest_neighbours(few, few).count() == 6
    assert not nearest_neighbours.nearest_neighbours(table.where("false"), queries.where("false")).collect()


def test_nearest_neighbours_recall_beside_many_copies(spark):
    draw = np.random.default_rng(6)
    matrix = np.float32(draw.normal(size=(1500, 16)))
    matrix[1200:] = matrix[1200]
    matrix[1200:, -1] = -6  # the copies stand lowest in the last component
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)], "vec_id long, embedding array<float>").repartition(4)
    got = defaultdict(set)
    for r in nearest_neighbours.nearest_neighbours(table, table.where("vec_id % 10 = 0")).collect():
        got[r.query_id].add(r.vec_id)
    x = matrix.astype(float)
    hits = []
    for q in range(0, 1200, 10):
        order = [i for i in np.lexsort((np.arange(len(x)), -(x @ x[q]))) if i != q][:20]
        hits.append(len(got[q] & set(order)) / 20)
    assert np.mean(hits) >= 0.94


def test_multi_index_walks_cells_in_order():
    draw = np.random.default_rng(3)
    index = nearest_neighbours.MultiIndex(draw.normal(size=(500, 6)), codes=7)
    query = draw.normal(size=6)
    walked = list(index.traverse(query, np.ones(index.cells, int), np.inf))
    near = (index.books[0] @ query[:3])[:, None] + (index.books[1] @ query[3:])[None]
    assert sorted(walked) == list(range(index.cells))
    assert np.all(np.diff(near.ravel()[walked]) <= 1e-12)


def test_mixture_meets_its_targets(spark):
    rows = [(i, f"s{i % 5}" if i % 7 else None, " ".join(["w"] * (i % 23))) for i in range(400)]
    rows += [(400, "s0", None), (401, "s0", ""), (402, "only", "a b  c\td"), (403, "s1", "w " * 5000), (None, "s1", "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 as size", "length(text) as n_chars").repartition(4)
    got = mixing.mix_table(docs).collect()
    again = mixing.mix_table(docs.repartition(7)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    size = lambda t: len((t or "").split())
    by_source = defaultdict(int)
    for _, s, t in rows:
        by_source[s] += size(t)
    names = sorted((s for s in by_source if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    budget, capped = 1.5 * sum(by_source.values()), set()
    while True:
        left = budget - sum(2 * by_source[s] for s in capped)
        level = left / sum(weight[s] for s in names if s not in capped)
        more = {s for s in names if s not in capped and level * weight[s] > 2 * by_source[s]}
        if not more:
            break
        capped |= more
    target = {s: 2.0 * by_source[s] if s in capped else level * weight[s] for s in names}
    source_of, taken = {i: s for i, s, _ in rows}, defaultdict(int)
    for r in got:
        s = source_of[r.doc_id]
        assert r.source_size == by_source[s] and abs(r.target - target[s]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size
        assert (r.position_1 is None) == (r.words_1 == 0) and (r.position_1 is None or 0 <= r.position_1 <= 1)
        taken[s] += r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= 1
    mixed = mixing.mixed_documents(docs).collect()
    assert sum(size(r.text) for r in mixed) == sum(r.taken for r in got)
    assert all(r.n_chars == len(r.text) for r in mixed)
    assert not mixing.mix_table(docs.where("false")).collect()


def test_schedule_is_inverted(spark):
    knots = mixing.Mix().schedules[0]
    grid = [i / 50 for i in range(51)]
    df = spark.createDataFrame([(d,) for d in grid], "d double")
    got = [r[1] for r in df.select("d", mixing.invert(knots, df["d"])).orderBy("d").collect()]
    fine = np.linspace(0, 1, 200_001)
    area = np.concatenate([[0], np.cumsum(np.interp((fine[1:] + fine[:-1]) / 2, *zip(*knots)) / 200_000)])
    assert np.allclose(got, np.interp(np.array(grid) * area[-1], area, fine), atol=1e-4)
