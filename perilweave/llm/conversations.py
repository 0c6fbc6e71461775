"""Cheapest repair of conversations whose roles and turns are damaged.

A conversation is a word over role and fault symbols. Re-Pair compresses the
words of many conversations into one grammar; every rule has a min-plus matrix
that takes the automaton of well-formed role sequences from any state to any
other, with the cheapest edits as a rope. Conversations that share a passage
share its rule.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b, sha256
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilweave.session import materialize

SEGMENT_ROWS = 1024
SEGMENT_BYTES = 1 << 19
PART_BYTES = 1 << 14
GRAMMAR_ROWS = 100_000
SPACES = " \t\n\x0b\x0c\r"
# Prices of the edits.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
LEGAL = {"su", "ua", "au"}
# States of the automaton of (s?(ua)+)?: nothing yet, after s, after u, after a.
STATES = range(4)
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
# How many insertions lead from state to state, and from a state to an accepted end.
INSERTED = {0: {0: 0, 2: 1, 3: 2}, 1: {1: 0, 2: 1, 3: 2}, 2: {2: 0, 3: 1}, 3: {3: 0, 2: 1}}
ENDED = {0: 0, 1: 2, 2: 1, 3: 0}


# ---------------------------------------------------------------- ropes and matrices


class Rope:
    """A string of edit initials: short ones as text, others as two parts that several ropes may share."""

    __slots__ = ("text", "left", "right", "length")

    def __init__(self, text: str | None, left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        self.length = len(text) if text is not None else left.length + right.length

    def __add__(self, other: Rope) -> Rope:
        if self.length + other.length <= 48:
            return Rope(self.text + other.text)
        return Rope(None, self, other)

    def parts(self) -> Iterator[str]:
        waiting = [self]
        while waiting:
            rope = waiting.pop()
            if rope.text is None:
                waiting += (rope.right, rope.left)
            else:
                yield rope.text

    def __str__(self) -> str:
        return "".join(self.parts())

    def compare(self, other: Rope) -> int:
        """Negative, 0 or positive, by the first letter that differs."""
        if self is other:
            return 0
        a, b, x, y = self.parts(), other.parts(), "", ""
        while True:
            x, y = x or next(a, ""), y or next(b, "")
            n = min(len(x), len(y))
            if not n or x[:n] != y[:n]:
                return (x > y) - (x < y)
            x, y = x[n:], y[n:]


Entry = tuple[int, Rope] | None
Matrix = list[list[Entry]]


def symbol_matrix(symbol: str) -> Matrix:
    """Cheapest (cost, edits) of one row from state to state; insertions stand before the row's own edit.

    A symbol is the role's initial (o for any other), in upper case if the text
    is truncated, or x for a row that has to go. All edits of a row end in its
    own letter, so of two different strings for the same rows neither begins
    the other, and comparing them is compatible with joining.
    """
    role, extra = symbol.lower(), TRUNCATED if symbol.isupper() else 0
    out: Matrix = [[None] * 4 for _ in STATES]
    for start in STATES:
        for at, inserted in INSERTED[start].items():
            ways = [(at, DELETE, "D")]
            if role != "x":
                ways += [(STEP[at, r], REROLE + extra, "R") for r in "ua" if (at, r) in STEP]
                if (at, role) in STEP:
                    ways.append((STEP[at, role], KEEP + extra, "K"))
            for end, cost, letter in ways:
                new = (INSERT * inserted + cost, "I" * inserted + letter)
                if out[start][end] is None or new < out[start][end]:
                    out[start][end] = new
    return [[e and (e[0], Rope(e[1])) for e in row] for row in out]


def _best(firsts: list[Entry], then: Matrix, end: int) -> Entry:
    """The best of all ways that go on from ``firsts`` (by state) to ``end``; ties by the letters."""
    best = None
    for state in STATES:
        a, b = firsts[state], then[state][end]
        if a is None or b is None:
            continue
        cost = a[0] + b[0]
        if best is not None and cost == best[0]:
            order = a[1].compare(best[1]) or b[1].compare(best[2])
        if best is None or cost < best[0] or (cost == best[0] and order < 0):
            best = (cost, a[1], b[1])
    return best and (best[0], best[1] + best[2])


def product(a: Matrix, b: Matrix) -> Matrix:
    return [[_best(row, b, end) for end in STATES] for row in a]


# ---------------------------------------------------------------- grammar


def re_pair(words: list[str], first_rule: int) -> tuple[list[tuple], list[list]]:
    """(rules, words over symbols and rules): the commonest neighbours become a rule until no pair occurs twice.

    Rule i is named ``first_rule + i``; ties go to the pair met first.
    """
    text: list = []
    for word in words:
        text += [None, *word]
    text.append(None)
    after, before = list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
    places: dict[tuple, dict[int, None]] = {}
    for i in range(len(text) - 1):
        if text[i] is not None and text[i + 1] is not None:
            places.setdefault((text[i], text[i + 1]), {})[i] = None
    met = {pair: n for n, pair in enumerate(places)}
    queue = [(-len(at), met[pair], pair) for pair, at in places.items() if len(at) > 1]
    heapify(queue)
    rules: list[tuple] = []

    def forget(pair: tuple, at: int) -> None:
        if pair in places:
            places[pair].pop(at, None)

    def note(pair: tuple, at: int) -> None:
        if None not in pair:
            found = places.setdefault(pair, {})
            found[at] = None
            if len(found) > 1:
                heappush(queue, (-len(found), met.setdefault(pair, len(met)), pair))

    while queue:
        count, _, pair = heappop(queue)
        if len(places.get(pair, ())) != -count:
            if len(places.get(pair, ())) > 1:
                heappush(queue, (-len(places[pair]), met[pair], pair))
            continue
        name = first_rule + len(rules)
        rules.append(pair)
        for at in sorted(places.pop(pair)):
            end = after[at]
            if text[at] != pair[0] or text[end] != pair[1]:
                continue  # overlaps the one before, as in aaa
            left, right = before[at], after[end]
            forget((text[left], pair[0]), left)
            forget((pair[1], text[right]), end)
            text[at], text[end] = name, 0
            after[at], before[right] = right, at
            note((text[left], name), left)
            note((name, text[right]), at)
    out, at = [], 0
    while at < len(text):
        if text[at] is None:
            out.append([])
        else:
            out[-1].append(text[at])
        at = after[at]
    return rules, out[:-1]


class Repairer:
    """Matrices of role and fault words, through one grammar for all words given together."""

    def __init__(self):
        self.symbols = {s: symbol_matrix(s) for s in "xsuaoSUAO"}

    def matrices(self, words: list[str]) -> list[Matrix]:
        """The matrix of each (non-empty) word."""
        rules, compressed = re_pair(words, 1)
        known: dict = dict(self.symbols)
        for name, (a, b) in enumerate(rules, 1):  # a rule only names earlier ones
            known[name] = product(known[a], known[b])
        out = []
        for word in compressed:
            whole = known[word[0]]
            for part in word[1:]:
                whole = product(whole, known[part])
            out.append(whole)
        return out


def finished(row: list[Entry]) -> tuple[int, str]:
    """Cheapest (cost, edits) of a whole conversation, given where each state is reached from the first."""
    ends = [(e[0] + INSERT * ENDED[s], str(e[1]) + "I" * ENDED[s]) for s, e in enumerate(row) if e]
    return min(ends)


# ---------------------------------------------------------------- rows of a conversation


def faults(roles: list[str], texts: list[str], seen: set[bytes]) -> str:
    """b (blank), d (duplicate), t (truncated) or . for each row; ``seen`` takes up the rows' digests."""
    out = []
    for role, text, key in zip(roles, texts, row_digests(roles, texts)):
        shown = text.rstrip(SPACES)
        out.append("b" if not shown else "d" if key in seen else "t" if shown[-1] not in ".!?" else ".")
        seen.add(key)
    return "".join(out)


def row_digests(roles: Iterable[str], texts: Iterable[str]) -> list[bytes]:
    return [blake2b(f"{len(r)}:{r}{t}".encode(), digest_size=16).digest() for r, t in zip(roles, texts)]


def word_of(roles: list[str], marks: str) -> str:
    """The conversation's word: one symbol a row, as ``symbol_matrix`` takes them."""
    out = []
    for role, mark in zip(roles, marks):
        kind = role[:1] if role[:1] in ("s", "u", "a") else "o"
        out.append("x" if mark in "bd" else kind.upper() if mark == "t" else kind)
    return "".join(out)


def illegal(roles: list[str]) -> int:
    return sum(a[:1] + b[:1] not in LEGAL for a, b in zip(roles[:-1], roles[1:]))


def repaired(roles: list[str], texts: list[str], edits: str, state: int = 0) -> list[str]:
    """The lines ``role:text`` that the edits leave, from a state of the automaton on."""
    named, lines, row = {"u": "user", "a": "assistant"}, [], 0
    for letter in edits:
        if letter == "D":
            row += 1
            continue
        role, text = "", ""
        if letter != "I":
            role, text = roles[row], texts[row]
            row += 1
        initial = role[:1] if letter == "K" else next(r for r in "ua" if (state, r) in STEP)
        lines.append(f"{role if letter == 'K' else named[initial]}:{text}")
        state = STEP[state, initial]
    return lines


def turn_summary(turns: list[int | None]) -> tuple[int | None, int | None, int]:
    present = [t for t in turns if t is not None]
    return min(present, default=None), max(present, default=None), len(set(present))


# ---------------------------------------------------------------- segments


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with planted faults, by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 takes full stops, exclamation and
    question marks out of it, 3 repeats the row, 4 sets its role to user. Nulls
    count as one space, in the key too; a null turn or conv_id stays null.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace(shown("text"), "[.!?]", ""))
    copies = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return conversations.withColumn("_kind", kind).where("_kind <> 0").select(
        "conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(shown("role")).alias("role"),
        text.otherwise(shown("text")).alias("text"), F.explode(copies).alias("_copy"),
    ).drop("_copy")


def conversation_key(conv_id: Column | str) -> Column:
    """A text for each conv_id; null has its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(conv_id).cast("string")), F.lit(""))


RESULTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
RESULT_NAMES = [c.split()[0] for c in RESULTS.split(", ")]
SEGMENT_SCHEMA = f"conv string, seg long, turns array<long>, roles array<string>, texts array<string>, digests array<binary>, {RESULTS}"
_RESULT_TYPES = [pa.int64()] * 6 + [pa.string()] * 2
_SEGMENT_TYPES = [
    pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.binary()), *_RESULT_TYPES,
]


def _whole(conversations: list[tuple], repairer: Repairer) -> list[list]:
    """Segment rows with the results of conversations that lie in one segment."""
    marked = [(conv, seg, turns, roles, texts, faults(roles, texts, set())) for conv, seg, turns, roles, texts in conversations]
    words = [word_of(roles, marks) for _, _, _, roles, _, marks in marked]
    distinct = list(dict.fromkeys(words))
    found = {w: finished(m[0]) for w, m in zip(distinct, repairer.matrices(distinct))} if distinct else {}
    out = []
    for word, (conv, seg, turns, roles, texts, marks) in zip(words, marked):
        low, high, n = turn_summary(turns)
        cost, audit = found[word]
        digest = sha256("\n".join(repaired(roles, texts, audit)).encode()).hexdigest()
        counts = [0 if low is None else high - low + 1 - n, *(marks.count(m) for m in "bdt"), illegal(roles)]
        out.append([conv, seg, None, None, None, None, *counts, cost, audit, digest])
    return out


def segments(rows: DataFrame) -> DataFrame:
    """Conversations in segments of bounded size; those that lie in one are repaired on the spot.

    Rows are dealt over ranges of (conversation, turn, role, text), so that a
    conversation of any length is spread, and come sorted. A conversation at
    the border of a range, or longer than a segment, gives its segments as they
    are, numbered in order. ``rows(conv, turn, role, text)``.
    """
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    keys = ["conv", "turn", "role", "text", "row"]
    ranged = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, *keys)

    def run(batches):
        repairer, number, conv, begun = Repairer(), TaskContext.get().partitionId() << 33, None, 0
        turns, roles, texts, size = [], [], [], 0
        ready: list[tuple] = []
        ready_rows, first, split = 0, True, False

        def record(out: list[list]) -> pa.RecordBatch:
            columns = list(zip(*out)) or [[]] * len(_SEGMENT_TYPES)
            names = [c.split()[0] for c in SEGMENT_SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _SEGMENT_TYPES)], names)

        def raw() -> pa.RecordBatch:
            digests = list(dict.fromkeys(row_digests(roles, texts)))
            return record([[conv, number, turns, roles, texts, digests, *[None] * len(RESULT_NAMES)]])

        for batch in batches:
            for c, turn, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv", "turn", "role", "text"))):
                if texts and (c != conv or len(texts) >= SEGMENT_ROWS or size + len(text) > SEGMENT_BYTES):
                    if c != conv and not first and not split:
                        ready.append((conv, number, turns, roles, texts))
                        ready_rows += len(texts)
                    else:
                        split = c == conv
                        yield raw()
                    first &= c == conv
                    number, turns, roles, texts, size = number + 1, [], [], [], 0
                    if ready_rows >= GRAMMAR_ROWS:
                        yield record(_whole(ready, repairer))
                        ready, ready_rows = [], 0
                conv = c
                turns.append(turn)
                roles.append(role)
                texts.append(text)
                size += len(text)
        if texts:
            yield raw()
        if ready:
            yield record(_whole(ready, repairer))

    return ranged.sortWithinPartitions(*keys).select(*keys[:-1]).mapInArrow(run, SEGMENT_SCHEMA)


# ---------------------------------------------------------------- conversations of several segments


def _analysed(key, table):
    """Faults, word and matrix of one segment, as costs, places of the edits among each other, and the edits."""
    row = {c: table.column(c)[0].as_py() for c in table.column_names}
    roles, texts = row["roles"], row["texts"]
    marks = faults(roles, texts, set(row["seen"] or ()))
    entries = [e for line in Repairer().matrices([word_of(roles, marks)])[0] for e in line]
    audits = [e and str(e[1]) for e in entries]
    place = {a: i for i, a in enumerate(sorted({a for a in audits if a}))}
    low, high, n = turn_summary(row["turns"])
    values = {
        "conv": key[0].as_py(), "seg": key[1].as_py(), "low": low, "high": high, "turns": n,
        "first": roles[0][:1], "last": roles[-1][:1], "blank": marks.count("b"), "duplicate": marks.count("d"),
        "truncated": marks.count("t"), "illegal": illegal(roles), "costs": [e and e[0] for e in entries],
        "places": [a and place[a] for a in audits], "audits": audits,
    }
    return pa.table([pa.array([values[c]], t) for c, t in _ANALYSIS], [c for c, _ in _ANALYSIS])


_ANALYSIS = [
    ("conv", pa.string()), ("seg", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()),
    ("first", pa.string()), ("last", pa.string()), ("blank", pa.int64()), ("duplicate", pa.int64()),
    ("truncated", pa.int64()), ("illegal", pa.int64()), ("costs", pa.list_(pa.int64())), ("places", pa.list_(pa.int64())),
    ("audits", pa.list_(pa.string())),
]
ANALYSIS = (
    "conv string, seg long, low long, high long, turns long, first string, last string, blank long, duplicate long, "
    "truncated long, illegal long, costs array<long>, places array<long>, audits array<string>"
)
_CHOICE_NAMES = ["conv", "seg", "entry", "tail", *RESULT_NAMES[:-2]]
CHOICES = "conv string, seg long, entry int, tail int, " + ", ".join(f"{c} long" for c in RESULT_NAMES[:-2])


def _chosen(key, table):
    """Which entry of each segment's matrix the cheapest repair takes, and what the conversation adds up to.

    Edits are compared by the places that their segments' strings have among
    each other; the strings themselves are not needed here.
    """
    rows = sorted(table.to_pylist(), key=lambda r: r["seg"])
    now: list = [(0, 0), None, None, None]  # (cost, place) by state
    back = []
    for row in rows:
        ways = []
        for end in STATES:
            choices = [
                (now[s][0] + row["costs"][4 * s + end], now[s][1], row["places"][4 * s + end], s)
                for s in STATES
                if now[s] is not None and row["costs"][4 * s + end] is not None
            ]
            ways.append(min(choices, default=None))
        order = {k: i for i, k in enumerate(sorted({w[1:3] for w in ways if w}))}
        now = [w and (w[0], order[w[1:3]]) for w in ways]
        back.append([w and w[3] for w in ways])
    cost, _, tail, state = min((n[0] + INSERT * ENDED[s], n[1], ENDED[s], s) for s, n in enumerate(now) if n)
    entries, tails = [], [0] * (len(rows) - 1) + [tail]
    for steps in reversed(back):
        entries.append(4 * steps[state] + state)
        state = steps[state]
    present = [r for r in rows if r["low"] is not None]
    same = sum(a["high"] == b["low"] for a, b in zip(present[:-1], present[1:]))
    distinct = sum(r["turns"] for r in present) - same
    sums = [sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated", "illegal")]
    sums[3] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(rows[:-1], rows[1:]))
    gaps = max(r["high"] for r in present) - min(r["low"] for r in present) + 1 - distinct if present else 0
    n = len(rows)
    totals = [[v] + [None] * (n - 1) for v in (gaps, *sums, cost)]
    columns = [[r["conv"] for r in rows], [r["seg"] for r in rows], entries[::-1], tails, *totals]
    types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 6]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], _CHOICE_NAMES)


def _written(key, table):
    """A segment's edits and its repaired lines, each after a line break, in parts of bounded size."""
    row = {c: table.column(c)[0].as_py() for c in table.column_names}
    audit = row["audit"] + "I" * row["tail"]
    lines = repaired(row["roles"], row["texts"], audit, row["entry"] // 4)
    data = "".join("\n" + line for line in lines).encode()
    parts = [data[i : i + PART_BYTES] for i in range(0, len(data), PART_BYTES)] or [b""]
    n = len(parts)
    columns = [[row["conv"]] * n, [row["seg"]] * n, list(range(n)), parts, [audit] + [""] * (n - 1)]
    types = [pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.string()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], ["conv", "seg", "part", "data", "audit"])


def _digested(batches):
    """audit and repaired_sha256 of each conversation, from its parts in order."""
    conv, state, edits = None, sha256(), []
    started = False

    def result() -> pa.RecordBatch:
        values = [[conv], ["".join(edits)], [state.hexdigest()]]
        return pa.RecordBatch.from_arrays([pa.array(v, pa.string()) for v in values], ["conv", "audit", "repaired_sha256"])

    for batch in batches:
        for c, data, audit in zip(*(batch.column(n).to_pylist() for n in ("conv", "data", "audit"))):
            if c != conv:
                if conv is not None:
                    yield result()
                conv, state, edits, started = c, sha256(), [], False
            edits.append(audit)
            state.update(data if started else data[1:])
            started |= bool(data)
    if conv is not None:
        yield result()


def _long_conversations(found: DataFrame) -> DataFrame:
    """Results of the conversations whose segments ``segments`` left as they are."""
    open_segments = found.where("texts is not null")
    rows = open_segments.select("conv", "seg", F.explode("digests").alias("digest"))
    first = rows.groupBy("conv", "digest").agg(F.min("seg").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = rows.join(first, ["conv", "digest"]).where("seg > first")
    later = later.groupBy("conv", "seg").agg(F.collect_list("digest").alias("seen"))  # one segment's digests at most
    texts = open_segments.select("conv", "seg", "turns", "roles", "texts")
    analysed = materialize(
        texts.join(later, ["conv", "seg"], "left").groupBy("conv", "seg").applyInArrow(_analysed, ANALYSIS), "analysed"
    )
    chosen = materialize(analysed.drop("audits").groupBy("conv").applyInArrow(_chosen, CHOICES), "chosen")
    picked = analysed.select("conv", "seg", "audits").join(chosen.select("conv", "seg", "entry", "tail"), ["conv", "seg"])
    picked = picked.select("conv", "seg", "entry", "tail", F.element_at("audits", F.col("entry") + 1).alias("audit"))
    parts = texts.drop("turns").join(picked, ["conv", "seg"]).groupBy("conv", "seg").applyInArrow(
        _written, "conv string, seg long, part int, data binary, audit string"
    )
    digests = parts.repartition("conv").sortWithinPartitions("conv", "seg", "part").mapInArrow(
        _digested, "conv string, audit string, repaired_sha256 string"
    )
    return chosen.where("cost is not null").join(digests, "conv").select("conv", *RESULT_NAMES)


# ---------------------------------------------------------------- operator


def repair(rows: DataFrame, conv_ids: DataFrame | None = None) -> DataFrame:
    """One row a conversation of ``rows(conv_id, turn, role, text)``: its faults and its cheapest repair.

    Rows count in order of turn (null first; within a turn by role and text,
    which keeps copies next to each other). gaps are the turns missing between
    the least and the largest, 0 if all are null. The first fault of a row
    counts: blank, duplicate (role and text stood in an earlier row), truncated
    (its last character but white space ends no sentence). illegal counts
    neighbours whose role initials are none of su, ua, au. audit is the
    cheapest string of edits (keep, rerole, delete, insert) after which the
    initials read ``(s?(ua)+)?``, of equal ones the least; repaired_sha256 is
    the digest of the lines ``role:text`` it leaves.

    ``conv_ids`` (conv_id) names conversations that need not have a row any
    more: zeros, an empty audit and the digest of nothing. A null conv_id is a
    conversation too; null roles and texts count as one space. Other columns
    are ignored; an empty table gives an empty one.

    Conversations within a segment are repaired where their rows were sorted.
    Longer ones are spread over segments, whose matrices are joined; only the
    digest of one conversation's lines, which no one can split, passes through
    one task, as a stream of parts.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    keyed = rows.select(conversation_key("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), shown("role"), shown("text"))
    found = materialize(segments(keyed), "segments")
    done = found.where("texts is null").select("conv", *RESULT_NAMES)
    results = done.union(_long_conversations(found))
    names = (rows if conv_ids is None else conv_ids).select("conv_id").distinct()
    names = names.withColumn("conv", conversation_key("conv_id"))
    nothing = {"audit": F.lit(""), "repaired_sha256": F.lit(sha256().hexdigest())}
    return names.join(results, "conv", "left").select(
        "conv_id", *[F.coalesce(c, nothing.get(c, F.lit(0).cast("long"))).alias(c) for c in RESULT_NAMES]
    )
