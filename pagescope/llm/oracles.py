"""DuckDB SQL of the queries whose rows SQL can tell."""

from __future__ import annotations

_SPACE_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TEXT = "coalesce(text, '')"
_BARE_WORDS = rf"list_filter(regexp_split_to_array({_LOWER.format(_TEXT)}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

_HEX = "list_reduce(list_transform(string_split(substr(h, 1 + 10 * {}, 10), ''), lambda c: (instr('0123456789abcdef', c) - 1)::BIGINT), lambda a, b: a * 16 + b)"
_BASE32 = " || ".join(f"array_to_string(list_transform(range(8), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({_HEX.format(k)} >> (35 - 5 * j)) & 31) + 1, 1)), '')" for k in range(4))

WARC = f"""WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to FROM f"""

NGRAM_JOIN = f"""WITH RECURSIVE w AS (SELECT doc_id, {_SPACE_WORDS.format(_LOWER.format(_TEXT))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM o JOIN n AS a ON a.doc_id = x JOIN n AS b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.c)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id) LEFT JOIN n USING (doc_id)"""

CHAT_FORMAT = r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) AS v)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
sum(24 + length(role) + 2 * length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '[', '')))::BIGINT AS formatted_chars FROM t GROUP BY conv_id"""

DECONTAMINATE = f"""WITH d AS (SELECT doc_id, {_BARE_WORDS} AS w FROM documents), i AS (SELECT item_id::VARCHAR AS item_id, w, least(len(w), 10) AS size FROM (SELECT item_id, {_BARE_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
b AS (SELECT DISTINCT item_id, size, unnest(list_transform(range(1, len(w) - size + 2), lambda k: array_to_string(w[k:k + size - 1], ' '))) AS g FROM i),
g AS (SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS pos, unnest(list_transform(range(1, len(w) - size + 2), lambda k: array_to_string(w[k:k + size - 1], ' '))) AS g FROM d, (SELECT DISTINCT size FROM b) WHERE len(w) >= size),
h AS (SELECT doc_id, size, pos, item_id FROM g JOIN b USING (size, g)),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS k, array_to_string(list_sort(list_distinct(list(item_id))), ',') AS ids FROM h GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_hit, coalesce(k, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""

SUBSTRING_DEDUP = f"""WITH d AS (SELECT doc_id, {_SPACE_WORDS.format(_TEXT)} AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS pos, unnest(list_transform(range(1, len(w) - 33), lambda k: md5(array_to_string(w[k:k + 34], ' ')))) AS g FROM d WHERE len(w) >= 35),
r AS (SELECT g FROM g GROUP BY g HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 35)) AS p FROM g JOIN r USING (g)),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS kept FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id) USING (doc_id)"""
