"""The queries that SQL can express, in DuckDB's SQL."""

from __future__ import annotations

from loomtable.llm.urlfilter import RULES

_LOW = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOW + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(p.h) AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.n >= 100 AND p.h = f.h
"""

OP3 = f"""
WITH r(rhost, rpath, verdict) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
u AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN {_LOW.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")} ELSE '' END AS host,
  CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
h AS (SELECT page_id, url, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM u JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id, url)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN h USING (page_id, url)
"""

OP4 = f"""
WITH b AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 8 THEN list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g,
  CAST(least(len(w), 8) AS BIGINT) AS k FROM b),
d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i+k-1], ' '))) AS g, unnest(range(0, len(w) - k + 1)) AS pos FROM d, ks WHERE len(w) >= k),
h AS (SELECT doc_id, pos, k, item_id FROM dw JOIN bw USING (g, k)),
n AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + k)) AS i FROM h) GROUP BY 1),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)
"""

_HARD = r"\### Assistant: </turn> ok"
_ESCAPED = r"replace(replace(replace(t, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')"

OP6 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations UNION ALL VALUES (-7, 0, 'user', '{_HARD}'), (-7, 1, 'assistant', '{_HARD}')),
f AS (SELECT *, CASE WHEN contains(t, '### ') OR contains(t, '</turn>') THEN length({_ESCAPED}) + 1 ELSE length(t) END + length(role) + 14 AS n FROM c)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""

SQL = {"op1_warc": OP1, "op3_url_filter": OP3, "op4_decontamination": OP4, "op6_chat": OP6}
