"""DuckDB statements for the two conversation operators: plain lists and a recursive table, no fingerprints or runs."""

from __future__ import annotations


def crc32(text: str) -> str:
    """CRC-32 (the reflected polynomial 0xEDB88320) of an ASCII text expression, bit by bit."""
    step = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda d, z: xor(d >> 1, (d & 1) * 3988292384))"
    letters = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {letters}), lambda c, b: {step}), 4294967295)"


WORDS = r"len(regexp_extract_all(x.text, '[^\x20\x09-\x0D]+'))"

TRIE = f"""
WITH t AS (
  SELECT conv_id, turn, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS x FROM conversations WHERE conv_id IS NOT NULL),
seqs AS (
  SELECT conv_id, list(x ORDER BY turn NULLS FIRST, x) AS s, {crc32("conv_id::VARCHAR")} % 4 AS h FROM t GROUP BY conv_id),
rebuilt AS (
  SELECT a.conv_id, list_concat(CASE WHEN a.h = 0 THEN [] ELSE coalesce(b.s[1:a.h], []) END, a.s[a.h + 1:]) AS s
  FROM seqs a LEFT JOIN seqs b ON b.conv_id = a.conv_id - a.conv_id % 20),
members AS (
  SELECT conv_id, depth, list_slice(s, 1, depth) AS node, depth = len(s) AS ends
  FROM (SELECT *, unnest(range(len(s) + 1)) AS depth FROM rebuilt)),
nodes AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ends
  FROM members GROUP BY node, depth),
children AS (SELECT list_slice(node, 1, depth - 1) AS node, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
own AS (
  SELECT node, depth, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * list_transform([node[depth]], lambda x: {WORDS})[1] END AS saved,
    CASE WHEN children.n IS NULL THEN 1 ELSE 0 END AS leaf
  FROM nodes LEFT JOIN children USING (node, depth)),
sums AS (
  SELECT list_slice(node, 1, d) AS node, d AS depth, sum(saved) AS saved, sum(leaf) AS leaves
  FROM (SELECT *, unnest(range(depth + 1)) AS d FROM own) GROUP BY ALL)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0)::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves,
  s.saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN sums s USING (node, depth) LEFT JOIN children c USING (node, depth)
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.node = list_slice(n.node, 1, n.depth - 1)
"""

REPAIR = rf"""
WITH RECURSIVE kinds AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) FROM kinds WHERE kind <> 0)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM damaged),
faulty AS (
  SELECT *, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
stats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE before IS NOT NULL AND before[1:1] || role[1:1] NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM faulty GROUP BY conv_id),
inserts(state, state2, letters, lines) AS (
  VALUES (0, 0, '', ''), (1, 1, '', ''), (2, 2, '', ''), (3, 3, '', ''), (0, 2, 'I', E'user:\n'), (1, 2, 'I', E'user:\n'), (3, 2, 'I', E'user:\n'),
    (2, 3, 'I', E'assistant:\n'), (0, 3, 'II', E'user:\nassistant:\n'), (1, 3, 'II', E'user:\nassistant:\n')),
edits AS (
  SELECT conv_id, i, s.state AS state2, e.state3, e.letter, e.cost, e.line
  FROM faulty f, (VALUES (0), (1), (2), (3)) s(state), LATERAL (VALUES
    (s.state, 'D', 3, ''),
    (CASE f.role[1:1] WHEN 's' THEN CASE s.state WHEN 0 THEN 1 END WHEN 'u' THEN CASE WHEN s.state <> 2 THEN 2 END
       WHEN 'a' THEN CASE s.state WHEN 2 THEN 3 END END, 'K', CASE f.fault WHEN 'truncated' THEN 1 ELSE 0 END, f.role || ':' || f.text || chr(10)),
    (CASE s.state WHEN 2 THEN 3 ELSE 2 END, 'R', CASE f.fault WHEN 'truncated' THEN 3 ELSE 2 END,
       CASE s.state WHEN 2 THEN 'assistant' ELSE 'user' END || ':' || f.text || chr(10))) e(state3, letter, cost, line)
  WHERE e.state3 IS NOT NULL AND (e.letter = 'D' OR f.fault NOT IN ('blank', 'duplicate'))),
best AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS state, {{'cost': 0, 'audit': '', 'lines': ''}} AS b FROM stats
  UNION ALL
  SELECT best.conv_id, best.i + 1, e.state3,
    min({{'cost': b.cost + 2 * len(m.letters)::INTEGER + e.cost, 'audit': b.audit || m.letters || e.letter, 'lines': b.lines || m.lines || e.line}})
  FROM best JOIN inserts m ON m.state = best.state
  JOIN edits e ON e.conv_id IS NOT DISTINCT FROM best.conv_id AND e.i = best.i + 1 AND e.state2 = m.state2
  GROUP BY best.conv_id, best.i, e.state3),
finished AS (
  SELECT best.conv_id, min({{'cost': b.cost + 2 * len(m.letters)::INTEGER, 'audit': b.audit || m.letters, 'lines': b.lines || m.lines}}) AS b
  FROM best JOIN stats s ON s.conv_id IS NOT DISTINCT FROM best.conv_id AND s.n = best.i JOIN inserts m ON m.state = best.state AND m.state2 IN (0, 3)
  GROUP BY best.conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.cost, 0)::BIGINT AS cost,
  coalesce(b.audit, '') AS audit, sha256(coalesce(rtrim_one, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN (SELECT *, CASE WHEN b.lines = '' THEN '' ELSE b.lines[1:-2] END AS rtrim_one FROM finished) f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
"""
