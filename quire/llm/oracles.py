"""SQL for the queries that SQL can express. The others need hashes, tokens or learned models that it has not;
they are tested against brute force."""

from __future__ import annotations

DECONTAMINATION = r"""
WITH lower_ AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM lower_),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bl AS (SELECT item_id, ws, least(10, len(ws)) AS n FROM b WHERE len(ws) > 0),
bw AS (SELECT DISTINCT n, item_id, array_to_string(ws[k:k + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS k FROM bl)),
dw AS (SELECT doc_id, n, k, array_to_string(ws[k:k + n - 1], ' ') AS win FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM w, (SELECT DISTINCT n FROM bl) WHERE len(ws) >= n)),
hit AS (SELECT DISTINCT doc_id, n, k, item_id FROM dw JOIN bw USING (n, win)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)"""

SUFFIX = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, k, substr(h, 2 * k + 1, 100) AS key FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS k FROM d WHERE length(h) >= 100)),
first AS (SELECT key, min(doc_id) AS m FROM s GROUP BY key HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, k, k > lag(k) OVER (PARTITION BY doc_id ORDER BY k) + 50 AS apart FROM s JOIN first USING (key) WHERE m < doc_id),
runs AS (SELECT doc_id, min(k) AS a, max(k) + 50 AS z FROM (SELECT doc_id, k, sum(CASE WHEN apart THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS r FROM hit) GROUP BY doc_id, r),
gaps AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM runs UNION ALL SELECT doc_id, max(z), NULL FROM runs GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(CASE WHEN y IS NULL THEN substr(h, 2 * x + 1) ELSE substr(h, 2 * x + 1, 2 * (y - x)) END, '' ORDER BY x) AS k FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
total AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN total USING (doc_id)"""

SUBSTRING = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, k, array_to_string(ws[k:k + 34], ' ') AS key FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS k FROM w WHERE len(ws) >= 35)),
again AS (SELECT key FROM win GROUP BY key HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 35)) AS p FROM win JOIN again USING (key)),
left_ AS (SELECT v.doc_id, v.p, v.word, g.p IS NOT NULL AS out FROM (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w) v LEFT JOIN gone g ON g.doc_id = v.doc_id AND g.p = v.p),
sums AS (SELECT doc_id, count(*) FILTER (out) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT out) AS kept FROM left_ GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN sums USING (doc_id)"""

WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS h FROM pages),
q AS (SELECT page_id, octet_length(h) AS n, sha256(h) AS digest FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM q)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to FROM r"""
