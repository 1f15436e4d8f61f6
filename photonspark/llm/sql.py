"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LOWER_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

OP1 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
line_counts AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
grams AS (
  SELECT r, i, w[i : i + 4] AS gram FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS times FROM grams) WHERE times > 1),
covered AS (
  SELECT r, count(DISTINCT pos) AS n_repeat_words
  FROM (SELECT r, unnest(range(i, i + 5)) AS pos FROM twice) GROUP BY r),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, len(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    len(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines, 0)::BIGINT AS n_lines,
    len(regexp_replace(text, '[^\pL]', '', 'g'))::BIGINT AS n_letters, len(regexp_replace(text, '[^\p{{Lu}}]', '', 'g'))::BIGINT AS n_upper
  FROM d LEFT JOIN line_counts USING (r) LEFT JOIN covered USING (r)),
b AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > 2 * n_words THEN 4 ELSE 0 END + CASE WHEN 10 * n_dup_lines > 4 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN 10 * n_upper > 4 * n_letters THEN 16 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 32 ELSE 0 END
    + CASE WHEN 10 * n_letters < 5 * word_chars THEN 64 ELSE 0 END)::BIGINT AS fail_bits
  FROM m)
SELECT *, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, 'training@1' AS policy FROM b
"""

#: Rules of each policy and their bits, counted on the ledger of ``OP1``.
POLICIES = rf"""
WITH l AS ({OP1}),
rules AS (SELECT unnest(['few_words', 'repeated_windows', 'symbols', 'duplicate_lines', 'shouting', 'word_length', 'few_letters']) AS rule, unnest([1, 2, 4, 8, 16, 32, 64]) AS bit),
p AS (SELECT 'base@1' AS policy, 3 AS mask UNION ALL SELECT 'training@1', 127)
SELECT p.policy, rule, bit::BIGINT AS bit, count(*) FILTER (fail_bits & bit <> 0) AS n_failed, count(*) FILTER (fail_bits & mask = bit) AS n_only_this,
  count(*) FILTER (fail_bits & (mask - bit) = 0) AS n_kept_without, bit_or(fail_bits & mask) FILTER (fail_bits & bit <> 0) AS fails_with
FROM l, rules, p WHERE bit & mask <> 0 GROUP BY ALL
"""

OP3 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_LOWER_WORDS} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN [w[1]] ELSE [w[i], w[i + 1]] END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) >= 1)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM pairs JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b
  WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, node) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON edges.a = reach.node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(node) AS component_id FROM reach GROUP BY doc_id) AS c USING (doc_id)
"""

OP5 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, payload_bytes, max(page_id) AS kept FROM p WHERE payload_bytes >= 1000 GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN kept IS NOT NULL AND page_id IS DISTINCT FROM kept THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN kept IS NOT NULL AND page_id IS DISTINCT FROM kept THEN kept END AS refers_to
FROM p LEFT JOIN g USING (payload_digest, payload_bytes)
"""

OP7 = rf"""
WITH d AS (SELECT doc_id, {_LOWER_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_LOWER_WORDS} AS w FROM benchmark),
dg AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN w ELSE w[i : i + 4] END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
bg AS (
  SELECT DISTINCT item_id, CASE WHEN len(w) < 5 THEN w ELSE w[i : i + 4] END AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n_item FROM bg GROUP BY item_id)
SELECT doc_id, item_id, any_value(n_item)::BIGINT AS n_item, count(*)::BIGINT AS n_shared, count(*)::DOUBLE / any_value(n_item) AS containment
FROM dg JOIN bg USING (g) JOIN n USING (item_id)
GROUP BY doc_id, item_id HAVING 100 * count(*) >= 80 * any_value(n_item)
"""

OP8 = """
WITH RECURSIVE m AS (
  SELECT conv_id, turn, role, text,
    CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
    CASE role WHEN 'user' THEN conv_id || ':' || turn WHEN 'assistant' THEN conv_id || ':' || (turn - 1) END AS call_id
  FROM conversations),
e AS (SELECT call_id, kind, min(turn) AS turn FROM m WHERE kind <> 'message' GROUP BY ALL),
o AS (SELECT call_id, CASE kind WHEN 'call' THEN 'result' ELSE 'call' END AS kind, turn AS linked_turn FROM e),
node AS (
  SELECT e.call_id, e.kind, CASE e.kind
      WHEN 'result' THEN 'call ' || e.call_id
      ELSE 'result ' || split_part(e.call_id, ':', 1) || ':' || (e.turn - 2) END AS parent
  FROM e),
lv(name, level) AS (
  SELECT kind || ' ' || call_id, 0::BIGINT FROM node WHERE parent NOT IN (SELECT kind || ' ' || call_id FROM node)
  UNION ALL
  SELECT kind || ' ' || call_id, level + 1 FROM lv JOIN node ON node.parent = lv.name)
SELECT conv_id, turn, role, m.kind, m.call_id, linked_turn, coalesce(level, 0) AS level,
  CASE WHEN m.kind = 'call' THEN text IS NOT NULL AND len(coalesce(text, '')) <= 300 END AS valid,
  '{' || CASE WHEN m.kind = 'call' THEN '"arguments":{"chars":' || len(coalesce(text, '')) || ',"text":' || to_json(text)::VARCHAR || '},' ELSE '"content":' || to_json(text)::VARCHAR || ',' END
    || '"conversation":' || conv_id || ',' || CASE WHEN m.call_id IS NULL THEN '' ELSE '"id":"' || m.call_id || '",' END
    || '"kind":"' || m.kind || '","level":' || coalesce(level, 0) || ',' || CASE WHEN m.kind = 'call' THEN '"name":"reply",' ELSE '' END
    || '"role":"' || role || '","turn":' || turn || '}' AS json
FROM m LEFT JOIN o ON o.call_id = m.call_id AND o.kind = m.kind LEFT JOIN lv ON lv.name = m.kind || ' ' || m.call_id
"""
