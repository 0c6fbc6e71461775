"""Conversation repair against a search over all edits, one conversation at a time."""

import heapq
import random
import re
from hashlib import sha256
from zlib import crc32

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from perilweave.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, cost int, seg string"
GOES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NAMES = (("u", "user"), ("a", "assistant"))


def damage(rows):
    out = []
    for c, t, r, x, *_ in rows:
        r, x = (" " if v is None else v for v in (r, x))
        kind = crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind == 0:
            continue
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        out += [(c, t, "user" if kind == 4 else r, x)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows, marks):
    """(cost, audit, lines) by a search that always goes on from the cheapest, least string of edits."""
    queue, closed, pushed = [(0, "", 0, 0, 0, None)], set(), iter(range(1, 1 << 60))
    while queue:
        cost, audit, _, i, state, lines = heapq.heappop(queue)
        if (i, state) in closed:
            continue
        if i == len(rows) and state in (0, 3):
            out = []
            while lines:
                lines, line = lines
                out.append(line)
            return cost, audit, out[::-1]
        closed.add((i, state))
        go = lambda c, letter, j, s, more: heapq.heappush(
            queue, (cost + c, audit + letter, next(pushed), j, s, (lines, *more) if more else lines)  # noqa: B023
        )
        for initial, name in NAMES:
            if (state, initial) in GOES and len(audit) < 3 * len(rows) + 3:
                go(3, "I", i, GOES[state, initial], (name + ":",))
        if i == len(rows):
            continue
        _, _, role, text = rows[i]
        go(4, "D", i + 1, state, ())
        if marks[i] not in "bd":
            extra = 3 if marks[i] == "t" else 0
            for initial, name in NAMES:
                if (state, initial) in GOES:
                    go(3 + extra, "R", i + 1, GOES[state, initial], (name + ":" + text,))
            if (state, role[:1]) in GOES:
                go(extra, "K", i + 1, GOES[state, role[:1]], (role + ":" + text,))


def by_search(rows, ids):
    by = {c: [] for c in ids}
    for r in rows:
        by[r[0]].append(r)
    out = []
    for c, rs in by.items():
        rs.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        turns, seen, marks = [r[1] for r in rs if r[1] is not None], set(), ""
        for r in rs:
            shown = re.findall(r"[^\x20\x09-\x0D]", r[3])
            marks += "b" if not shown else "d" if r[2:] in seen else "t" if shown[-1] not in ".!?" else "."
            seen.add(r[2:])
        bad = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rs, rs[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, lines = cheapest(rs, marks)
        digest = sha256("\n".join(lines).encode()).hexdigest()
        out.append((c, gaps, *(marks.count(m) for m in "bdt"), bad, cost, audit, digest))
    return sorted(out, key=repr)


def planted(n, conversations, seed):
    rnd = random.Random(seed)
    return [
        (
            rnd.choice([rnd.randrange(conversations)] * 30 + [None]), rnd.choice([rnd.randrange(12)] * 15 + [None]),
            rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "u"]),
            rnd.choice([None, "", " \n", "Hi.", "no", "Yes!", "What? ", "x.y", "long text here.", "é\n。"]), 1, "clash",
        )
        for _ in range(n)
    ]


@pytest.mark.parametrize("n, conversations, segment", [(0, 1, 1024), (1, 1, 1024), (300, 60, 1024), (300, 60, 3), (400, 8, 4), (60, 3, 2)])
def test_equals_a_search_over_all_edits(spark, monkeypatch, n, conversations, segment):
    monkeypatch.setattr(C, "SEGMENT_ROWS", segment)
    monkeypatch.setattr(C, "PART_BYTES", 16)
    rows = planted(n, conversations, n + segment)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5) if rows else spark.createDataFrame([], SCHEMA)
    got = C.repair(C.damaged(df), df)
    assert got.columns == ["conv_id", *C.RESULT_NAMES]
    assert sorted(map(tuple, got.collect()), key=repr) == by_search(damage(rows), {r[0] for r in rows})


def test_one_conversation_of_many_rows_and_long_texts(spark):
    rows = [(7, i, "user" if i % 2 else "assistant", f"{i % 1900} says so." if i % 11 else "w" * 3000) for i in range(2500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    assert list(map(tuple, C.repair(df).collect())) == by_search(rows, {7})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("xsuaoSUAO", min_size=1, max_size=12), min_size=1, max_size=6))
def test_matrices_of_a_grammar_equal_those_of_its_symbols(words):
    repairer = C.Repairer()
    for word, matrix in zip(words, repairer.matrices(words)):
        plain = repairer.symbols[word[0]]
        for symbol in word[1:]:
            plain = C.product(plain, repairer.symbols[symbol])
        show = lambda m: [[e and (e[0], str(e[1])) for e in row] for row in m]
        assert show(matrix) == show(plain)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=30), min_size=1, max_size=5))
def test_re_pair_expands_to_its_words_and_leaves_no_pair_twice(words):
    rules, compressed = C.re_pair(words, 1)
    spell = lambda s: s if isinstance(s, str) else "".join(map(spell, rules[s - 1]))
    assert ["".join(map(spell, w)) for w in compressed] == words
    pairs = [p for w in compressed for p in zip(w, w[1:])]
    apart = {}
    for p in pairs:
        apart[p] = apart.get(p, 0) + 1
    assert all(n == 1 or p[0] == p[1] for p, n in apart.items())


def test_ropes_compare_as_their_texts():
    rnd = random.Random(1)
    for _ in range(300):
        made = []
        for _ in range(2):
            rope = C.Rope("K")
            for _ in range(rnd.randrange(6)):
                rope = rope + (C.Rope("D" * rnd.randrange(30)) if rnd.random() < 0.7 else rope)
            made.append(rope)
        a, b = map(str, made)
        assert made[0].compare(made[1]) == (a > b) - (a < b)
