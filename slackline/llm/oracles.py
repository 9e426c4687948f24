"""DuckDB SQL of those corpus queries that SQL can express on whole tables."""

MIX = """WITH RECURSIVE sizes AS (SELECT source, count(*) AS n, round(pow(CAST(count(*) AS DOUBLE), 0.7), 6) AS share FROM documents GROUP BY source),
tot AS (SELECT 1000 - count(*) AS room, sum(share) AS shares FROM sizes),
whole AS (SELECT source, n, round(share / shares * room, 6) AS exact, room FROM sizes, tot),
ranked AS (SELECT *, floor(exact) AS w, row_number() OVER (ORDER BY round(exact - floor(exact), 6) DESC, source NULLS FIRST) AS r, room - sum(floor(exact)) OVER () AS spare FROM whole),
weights AS (SELECT source, n, CAST(1 + w + CASE WHEN r <= spare THEN 1 ELSE 0 END AS INTEGER) AS parts FROM ranked),
s AS (SELECT *, row_number() OVER (ORDER BY parts, source IS NOT NULL, source) AS i FROM weights),
lists AS (SELECT list(parts ORDER BY i) AS p, list(source ORDER BY i) AS src FROM s),
sim(slot, k, pick) AS (
  SELECT -1, list_transform(p, lambda x: 0), 0 FROM lists
  UNION ALL
  SELECT slot + 1, list_transform(range(1, len(k) + 1), lambda j: k[j] + CASE WHEN j = choice THEN 1 ELSE 0 END), choice
  FROM (SELECT slot, k, list_min(list_filter(list_transform(range(1, len(k) + 1), lambda j: CASE WHEN k[j] < p[j] AND k[j] * 1000 < (slot + 2) * p[j] THEN CAST(ceil((k[j] + 1) * 1000 / p[j]) AS BIGINT) * 10000 + j END), lambda v: v IS NOT NULL)) % 10000 AS choice FROM sim, lists WHERE slot < 999)),
slots AS (SELECT slot, src[pick] AS source, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS k FROM sim, lists WHERE slot >= 0),
periods AS (SELECT max(ceil(n / parts)) AS periods FROM weights),
len AS (SELECT max((n - 1) // parts * 1000 + slot) + 1 AS total FROM weights w JOIN slots x ON x.source IS NOT DISTINCT FROM w.source AND x.k = (n - 1) % parts),
docs AS (SELECT d.doc_id, d.source, w.n, w.parts, row_number() OVER (PARTITION BY d.source ORDER BY md5(coalesce(CAST(d.doc_id AS VARCHAR), 'null'))) - 1 AS rank FROM documents d JOIN weights w ON w.source IS NOT DISTINCT FROM d.source),
uses AS (SELECT doc_id, source, parts, rank + e * n AS block, e AS epoch FROM (SELECT *, unnest(range(0, CAST(periods AS BIGINT) * parts // n + 2)) AS e FROM docs, periods) WHERE rank + e * n < periods * parts)
SELECT CAST(block // u.parts * 1000 + x.slot AS BIGINT) AS position, doc_id, u.source, CAST(block AS BIGINT) AS block, CAST(epoch AS BIGINT) AS epoch, u.parts FROM uses u JOIN slots x ON x.source IS NOT DISTINCT FROM u.source AND x.k = block % u.parts, len WHERE block // u.parts * 1000 + x.slot < total"""

#: A-Z in lower case, other letters as they are.
LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ') || ' '] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.seen),
c AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""

LEAKS = rf"""
WITH words AS (SELECT doc_id, regexp_extract_all({LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all({LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
phrases AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS phrase FROM items WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM phrases),
grams AS (SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS place, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase FROM words, sizes WHERE len(w) >= size),
hits AS (SELECT g.doc_id, g.place, g.size, p.item_id FROM grams g JOIN phrases p ON p.size = g.size AND p.phrase = g.phrase),
h AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(place, place + size)) AS word FROM hits) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM words w LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)"""

VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
ok AS (SELECT * FROM v WHERE x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_sum(list_transform(x, lambda c: c * c)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95),
r(vec_id, seen) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.seen),
c AS (SELECT vec_id, min(seen) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT c.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""

#: Every 50-byte string of every text, by its bytes.
REPEATS = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS h FROM documents),
w AS (SELECT doc_id, unnest(range(0, CAST(octet_length(h) - 49 AS BIGINT))) AS p, unnest(list_transform(range(0, CAST(octet_length(h) - 49 AS BIGINT)), lambda i: h[i + 1:i + 50])) AS x FROM d WHERE octet_length(h) >= 50),
m AS (SELECT x, min(doc_id) AS least FROM w GROUP BY x),
r AS (SELECT w.doc_id, w.p FROM w JOIN m ON m.x = w.x WHERE w.doc_id > m.least),
g AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS fresh FROM r),
k AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM g),
spans AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS b FROM k GROUP BY doc_id, k),
q AS (SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f FROM spans),
t AS (SELECT q.doc_id, string_agg(hex(d.h[q.f + 1:q.a]), '' ORDER BY q.a) AS head FROM q JOIN d ON d.doc_id = q.doc_id GROUP BY q.doc_id),
e AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS past FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(octet_length(d.h) AS BIGINT) AS n_bytes, CAST(coalesce(e.n_removed, 0) AS BIGINT) AS n_removed, coalesce(e.n_spans, 0) AS n_spans, sha256(unhex(coalesce(t.head, '') || hex(d.h[coalesce(e.past, 0) + 1:octet_length(d.h)]))) AS kept_sha256
FROM d LEFT JOIN e ON e.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""
