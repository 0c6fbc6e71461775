"""DuckDB SQL for the manifest and for the repair of conversations, row by row and level by level."""

from __future__ import annotations

from .conversations import DELETE, INSERT, REROLE, TRUNCATED


def crc32_sql(text: str) -> str:
    """Unsigned crc32 of an ASCII text, one bit after the other."""
    bits = "list_reduce(list_prepend(xor(c, b), [0::UBIGINT for z in range(8)]), lambda x, y: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384::UBIGINT ELSE 0 END))"
    octets = f"list_transform(string_split({text}, ''), lambda s: ascii(s)::UBIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {octets}), lambda c, b: {bits}), 4294967295::UBIGINT)"


def _leaf_sql(n_chars: str) -> str:
    shown = (f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", n_chars, "text"))
    return "sha256(" + " || ".join(shown) + ")"


MANIFEST = f"""
    WITH RECURSIVE d AS (
      SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf,
        CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_leaf_sql("n_chars + 1")} ELSE {_leaf_sql("n_chars")} END AS shown
      FROM documents),
    p AS (
      SELECT *, coalesce('=' || lang, '') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
        count(*) OVER (PARTITION BY lang) AS n FROM d),
    low AS (
      SELECT tree, 0 AS level, i, n, leaf AS h FROM p
      UNION ALL
      SELECT tree, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM low WHERE n > 1
      GROUP BY tree, level, i // 2, n),
    sub AS (SELECT tree, level AS depth, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS t, count(*) OVER () AS n FROM low WHERE n = 1),
    high AS (
      SELECT 0 AS level, t AS i, n, subroot AS h FROM sub
      UNION ALL
      SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM high WHERE n > 1
      GROUP BY level, i // 2, n),
    step AS (
      SELECT p.tree, p.i, level, CASE WHEN low.i < (p.i >> level) THEN 'L' ELSE 'R' END AS side, h
      FROM p JOIN low ON low.tree = p.tree AND low.i = xor(p.i >> level, 1) AND low.n > 1
      UNION ALL
      SELECT p.tree, p.i, depth + level, CASE WHEN high.i < (t >> level) THEN 'L' ELSE 'R' END, h
      FROM p JOIN sub USING (tree) JOIN high ON high.i = xor(t >> level, 1) AND high.n > 1),
    deep AS (SELECT tree, depth + (SELECT max(level) FROM high) AS depth FROM sub),
    fold AS (
      SELECT tree, i, 0 AS level, shown AS h FROM p
      UNION ALL
      SELECT fold.tree, fold.i, fold.level + 1,
        sha256(CASE side WHEN 'L' THEN step.h || fold.h WHEN 'R' THEN fold.h || step.h ELSE fold.h END)
      FROM fold JOIN deep USING (tree) LEFT JOIN step ON step.tree = fold.tree AND step.i = fold.i AND step.level = fold.level
      WHERE fold.level < deep.depth),
    proof AS (SELECT tree, i, string_agg(h, '' ORDER BY level) AS hs FROM step GROUP BY tree, i)
    SELECT doc_id, leaf, subroot, (SELECT h FROM high WHERE n = 1) AS root, sha256(coalesce(hs, '')) AS proof_sha256,
      fold.h AS folded_root, fold.h = (SELECT h FROM high WHERE n = 1) AS verified
    FROM p JOIN sub USING (tree) JOIN deep USING (tree) LEFT JOIN proof ON proof.tree = p.tree AND proof.i = p.i
    JOIN fold ON fold.tree = p.tree AND fold.i = p.i AND fold.level = deep.depth"""

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_KEY = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"

CONVERSATIONS = f"""
    WITH RECURSIVE c AS (
      SELECT conv_id, coalesce('=' || conv_id, '') AS k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        {crc32_sql(_KEY)} % 20 AS kind FROM conversations),
    e AS (
      SELECT k, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
      FROM c WHERE kind <> 0),
    o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text, copy) AS i, left(role, 1) AS r FROM e),
    m AS (
      SELECT *, right(rtrim(text, {_SPACES}), 1) AS last,
        row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 AS again,
        lead(r) OVER (PARTITION BY k ORDER BY i) AS follows FROM o),
    f AS (
      SELECT *, CASE WHEN last = '' THEN 'b' WHEN again THEN 'd' WHEN last NOT IN ('.', '!', '?') THEN 't' ELSE '.' END AS mark FROM m),
    n AS (
      SELECT k, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (mark = 'b') AS blank, count(*) FILTER (mark = 'd') AS duplicate, count(*) FILTER (mark = 't') AS truncated,
        count(*) FILTER (follows IS NOT NULL AND r || follows NOT IN ('su', 'ua', 'au')) AS illegal
      FROM f GROUP BY k),
    goes(z, r, y) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
    added(x, z, n) AS (VALUES (0, 0, 0), (0, 2, 1), (0, 3, 2), (1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 2, 0), (2, 3, 1), (3, 3, 0), (3, 2, 1)),
    ended(y, n) AS (VALUES (0, 0), (1, 2), (2, 1), (3, 0)),
    edit AS (
      SELECT k, i, z, z AS y, {DELETE} AS cost, 'D' AS letter FROM f, (SELECT DISTINCT z FROM added)
      UNION ALL
      SELECT k, i, z, y, {REROLE} + CASE mark WHEN 't' THEN {TRUNCATED} ELSE 0 END, 'R' FROM f, goes WHERE goes.r IN ('u', 'a') AND mark IN ('t', '.')
      UNION ALL
      SELECT k, i, z, y, CASE mark WHEN 't' THEN {TRUNCATED} ELSE 0 END, 'K' FROM f JOIN goes USING (r) WHERE mark IN ('t', '.')),
    way AS (
      SELECT k, i, x, y, cost + {INSERT} * n AS cost, repeat('I', n) || letter AS letters FROM edit JOIN added USING (z)),
    dp AS (
      SELECT k, CAST(0 AS BIGINT) AS i, 0 AS s, {{'cost': CAST(0 AS BIGINT), 'audit': ''}} AS best FROM n
      UNION ALL
      SELECT dp.k, way.i, y, min({{'cost': CAST(dp.best.cost + way.cost AS BIGINT), 'audit': dp.best.audit || letters}})
      FROM dp JOIN way ON way.k = dp.k AND way.i = dp.i + 1 AND x = s GROUP BY dp.k, way.i, y),
    won AS (
      SELECT dp.k, min({{'cost': dp.best.cost + {INSERT} * ended.n, 'audit': dp.best.audit || repeat('I', ended.n)}}) AS best
      FROM dp JOIN n ON n.k = dp.k AND dp.i = n.rows JOIN ended ON y = s GROUP BY dp.k),
    letter AS (SELECT k, unnest(range(1, len(best.audit) + 1)) AS pos, best.audit AS audit FROM won),
    placed AS (
      SELECT k, pos, audit[pos] AS l, count(*) FILTER (audit[pos] <> 'D') OVER w AS out, count(*) FILTER (audit[pos] <> 'I') OVER w AS i,
        len(replace(audit, 'D', '')) % 2 AS odd
      FROM letter WINDOW w AS (PARTITION BY k ORDER BY pos)),
    line AS (
      SELECT placed.k, pos, CASE WHEN l = 'K' THEN f.role WHEN (out - odd) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':'
        || CASE WHEN l = 'I' THEN '' ELSE f.text END AS line
      FROM placed LEFT JOIN f ON f.k = placed.k AND f.i = placed.i WHERE l <> 'D'),
    text AS (SELECT k, string_agg(line, chr(10) ORDER BY pos) AS lines FROM line GROUP BY k)
    SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
      coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost,
      coalesce(best.audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id, k FROM c) LEFT JOIN n USING (k) LEFT JOIN won USING (k) LEFT JOIN text USING (k)"""
