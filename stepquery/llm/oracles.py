"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from .chat import ORACLE as CHAT

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

JACCARD = f"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(string_split_regex(translate(COALESCE(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM split),
sizes AS MATERIALIZED (SELECT doc_id, len(s) AS n FROM sets),
grams AS MATERIALIZED (SELECT doc_id, hash(g) AS g FROM (SELECT doc_id, unnest(s) AS g FROM sets)),
shared AS (SELECT g FROM grams GROUP BY g HAVING COUNT(*) > 1),
kept AS MATERIALIZED (SELECT doc_id, g FROM grams SEMI JOIN shared USING (g)),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, COUNT(*) AS c FROM kept a JOIN kept b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
pairs AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM sizes UNION SELECT r.x, b.y FROM reach r JOIN pairs b ON b.x = r.y)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, MIN(r.y) AS component_id FROM sizes s JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id, s.n
"""

_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> {}) & 31) + 1, 1)"
#: Five hexadecimal digits are four of base 32.
WARC = f"""
WITH p AS (SELECT page_id, COALESCE(html, '') AS body, upper(sha1(COALESCE(html, ''))) AS h FROM pages),
d AS (
  SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, MIN(page_id) OVER (PARTITION BY body) AS first,
    list_transform(range(0, 8), lambda k: CAST('0x' || substr(h, CAST(k * 5 + 1 AS INTEGER), 5) AS INTEGER)) AS groups FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(groups, lambda v: {' || '.join(_DIGIT.format(k) for k in (15, 10, 5, 0))}), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM d
"""

ORACLE_SQL = {"op1_jaccard": JACCARD, "op6_chat": CHAT, "op9_warc": WARC}
