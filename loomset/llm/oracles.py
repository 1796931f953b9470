"""DuckDB SQL for operators whose checksums or folds DuckDB has no function for: they are spelled out here."""

from __future__ import annotations

#: crc32 by bytes: a table of 256 numbers made from the polynomial, and a fold over a list of bytes.
CRC_TABLE = """tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(i)))"""


def crc(of_bytes: str) -> str:
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {of_bytes}), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)))"


def spent(state: str, cost: str | int, letter: str) -> str:
    """A state is the cost in six digits and the edits' letters."""
    return f"(lpad(CAST(CAST({state}[1:6] AS INT) + {cost} AS VARCHAR), 6, '0') || {state}[7:] || '{letter}')"


def turns() -> str:
    never = "'900000'"

    def when(initial: str, state: str) -> str:
        return f"CASE WHEN NOT go AND i = '{initial}' THEN {spent(state, 'x', 'K')} ELSE {never} END"

    def rerole(state: str) -> str:
        return f"CASE WHEN NOT go THEN {spent(state, 'x + 2', 'R')} ELSE {never} END"

    user = ", ".join([spent("c2", 3, "D"), *(when("u", s) for s in ("c0", "c1", "c3")), *(rerole(s) for s in ("c0", "c1", "c3"))])
    return f"""
WITH RECURSIVE {CRC_TABLE},
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS r0, coalesce(text, ' ') AS t0, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
d AS (SELECT conv_id, turn, r0, t0, {crc("list_transform(string_split(name, ''), lambda x: CAST(ascii(x) AS BIGINT))")} % 20 AS kind FROM k, tab),
e AS (SELECT conv_id, turn, r0, t0, CASE kind WHEN 4 THEN 'user' ELSE r0 END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(t0, '.!?', '') ELSE t0 END AS text, unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r0, t0, copy) AS n, rtrim(text, E' \\t\\n\\x0b\\x0c\\r') AS black FROM e),
f AS (SELECT *, left(role, 1) AS i, CASE WHEN black = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate' WHEN right(black, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault FROM o),
g AS (SELECT *, fault IN ('blank', 'duplicate') AS go, CASE fault WHEN 'truncated' THEN 1 ELSE 0 END AS x, lag(i) OVER (PARTITION BY conv_id ORDER BY n) || i AS pair FROM f),
s AS (
  SELECT conv_id, 0 AS n, '000000' AS c0, {never} AS c1, '000002I' AS c2, '000004II' AS c3 FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, n, b0, b1, b2, least(b3, {spent("b2", 2, "I")}) FROM (
    SELECT conv_id, n, b0, b1, least(b2, {spent("b0", 2, "I")}, {spent("b1", 2, "I")}, {spent("b3", 2, "I")}) AS b2, b3 FROM (
      SELECT s.conv_id, g.n, {spent("c0", 3, "D")} AS b0, least({spent("c1", 3, "D")}, {when("s", "c0")}) AS b1, least({user}) AS b2, least({spent("c3", 3, "D")}, {when("a", "c2")}, {rerole("c2")}) AS b3
      FROM s JOIN g ON s.conv_id IS NOT DISTINCT FROM g.conv_id AND g.n = s.n + 1))),
z AS (SELECT conv_id, max_by(least(c0, c3), n) AS best FROM s GROUP BY conv_id),
a AS (SELECT conv_id, CAST(best[1:6] AS BIGINT) AS cost, best[7:] AS audit FROM z),
p AS (SELECT conv_id, unnest(range(1, len(audit) + 1)) AS pos, audit FROM a),
q AS (SELECT conv_id, pos, audit[pos] AS edit, pos - len(replace(audit[1:pos], 'I', '')) AS ins FROM p),
l AS (SELECT q.conv_id, q.pos, q.edit, g.role, CASE WHEN q.edit = 'I' THEN '' ELSE g.text END AS text, row_number() OVER (PARTITION BY q.conv_id ORDER BY q.pos) AS j FROM q LEFT JOIN g ON q.conv_id IS NOT DISTINCT FROM g.conv_id AND g.n = q.pos - q.ins WHERE q.edit <> 'D'),
h AS (SELECT *, max(CASE WHEN j = 1 AND edit = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS first_s FROM l),
m AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (j + first_s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY pos) AS whole FROM h GROUP BY conv_id),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM a LEFT JOIN m ON a.conv_id IS NOT DISTINCT FROM m.conv_id LEFT JOIN c ON a.conv_id IS NOT DISTINCT FROM c.conv_id
"""


def importance() -> str:
    words = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    return f"""
WITH {CRC_TABLE},
w AS (SELECT 0 AS c, doc_id AS id, {words} AS w FROM documents UNION ALL SELECT 1, item_id, {words} FROM benchmark),
y AS (SELECT x, list_transform(range(0, len(h) // 2), lambda i: CAST(strpos('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) * 16 + strpos('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 17 AS BIGINT)) AS y
  FROM (SELECT x, hex(encode(x)) AS h FROM (SELECT DISTINCT unnest(w) AS x FROM w))),
n AS (SELECT c, id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
p AS (SELECT c, id, x, lead(x) OVER v AS x2, lead(x, 2) OVER v AS x3 FROM n WINDOW v AS (PARTITION BY c, id ORDER BY i)),
f AS (SELECT c, id, x, NULL AS x2, NULL AS x3 FROM p UNION ALL SELECT c, id, x, x2, NULL FROM p WHERE x2 IS NOT NULL UNION ALL SELECT c, id, x, x2, x3 FROM p WHERE x3 IS NOT NULL),
m AS (SELECT x, coalesce(x2, '') AS x2, coalesce(x3, '') AS x3, count(*) FILTER (c = 0) AS ns, count(*) FILTER (c = 1) AS nt FROM f GROUP BY ALL),
k AS (SELECT m.*, y1.y || CASE WHEN x2 = '' THEN [] ELSE [CAST(32 AS BIGINT)] || y2.y END || CASE WHEN x3 = '' THEN [] ELSE [CAST(32 AS BIGINT)] || y3.y END AS bytes FROM m JOIN y y1 ON y1.x = m.x LEFT JOIN y y2 ON y2.x = m.x2 LEFT JOIN y y3 ON y3.x = m.x3),
b AS (SELECT x, x2, x3, ns, nt, {crc("bytes")} % 10000 AS b FROM k, tab),
q AS (SELECT b, sum(ns) AS s, sum(nt) AS t FROM b GROUP BY b),
z AS (SELECT sum(s) AS s, sum(t) AS t FROM q),
g AS (SELECT b, CAST(floor(1000 * ln(CAST((q.t + 1) * (z.s + 10000) AS DOUBLE) / CAST((q.s + 1) * (z.t + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM q, z),
e AS (SELECT id, count(*) AS n, sum(gain) AS weight FROM f JOIN b ON f.x = b.x AND coalesce(f.x2, '') = b.x2 AND coalesce(f.x3, '') = b.x3 JOIN g USING (b) WHERE c = 0 GROUP BY id),
d AS (SELECT doc_id, len(w.w) AS words, coalesce(e.n, 0) AS n_features, CAST(coalesce(e.weight, 0) AS BIGINT) AS weight, CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) AS h FROM documents JOIN w ON w.c = 0 AND w.id = doc_id LEFT JOIN e ON e.id = doc_id),
r AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, 5 * count(*) OVER () // 100 AS drawn FROM r WHERE words >= 20)
SELECT r.doc_id, n_features, weight, score, CASE WHEN o.place <= o.drawn THEN o.place END AS rank FROM r LEFT JOIN o USING (doc_id)
"""
