"""SQL of the queries that SQL can express."""

from __future__ import annotations

OP2 = """WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
 array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(d, 10 * (k // 8) + 1, 10) AS BIGINT) >> (35 - 5 * (k % 8))) & 31) AS INTEGER) + 1, 1) for k in range(32)], '') AS payload_digest,
 CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3 = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
i AS (SELECT item_id, w, least(13, len(w)) AS k FROM b WHERE len(w) > 0), iw AS (SELECT DISTINCT item_id, k, array_to_string(w[j + 1 : j + k], ' ') AS x FROM (SELECT *, unnest(range(0, len(w) - k + 1)) AS j FROM i)),
dw AS (SELECT doc_id, k, j, array_to_string(w[j + 1 : j + k], ' ') AS x FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS j FROM d, (SELECT DISTINCT k FROM i) WHERE len(w) >= k)),
m AS (SELECT doc_id, item_id, dw.k, j FROM dw JOIN iw ON dw.k = iw.k AND dw.x = iw.x), h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + k)) AS p FROM m) GROUP BY 1),
o AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN o ON d.doc_id = o.doc_id"""

OP10 = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[j + 1 : j + least(5, len(w))], ' ') AS x FROM (SELECT *, unnest(range(0, greatest(len(w) - 4, 1))) AS j FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 80 * (p.n + q.n - i)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS c FROM r GROUP BY 1) ON a = d.doc_id"""

_PIECES = rf"SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents"
OP11 = rf"""WITH p AS ({_PIECES}), w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p), t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1),
g AS (SELECT lang, k, array_to_string(w[j + 1 : j + k], ' ') AS x FROM (SELECT lang, w, k, unnest(range(0, len(w) - k + 1)) AS j FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, x, count(*) AS f FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 30), c AS (SELECT lang, k, x, f, string_split(x, ' ') AS w FROM f WHERE k > 1),
h AS (SELECT lang, x, max(f) AS most FROM (SELECT lang, f, unnest([array_to_string(w[1 : k - 1], ' '), array_to_string(w[2 : k], ' ')]) AS x FROM c WHERE k > 2) GROUP BY 1, 2),
v AS (SELECT c.* FROM c LEFT JOIN h ON h.lang = c.lang AND h.x = c.x WHERE 100 * coalesce(most, 0) < 80 * f), u AS (SELECT lang, k, x, f, array_to_string(w[1 : i], ' ') AS y, array_to_string(w[i + 1 : k], ' ') AS z, i FROM (SELECT *, unnest(range(1, k)) AS i FROM v)),
s AS (SELECT u.lang, u.x, u.f AS a, y.f AS l, z.f AS r, i, CAST(CAST(2000000 AS HUGEINT) * u.f // (y.f + z.f) AS BIGINT) AS score FROM u JOIN f y ON y.lang = u.lang AND y.x = u.y JOIN f z ON z.lang = u.lang AND z.x = u.z),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, x ORDER BY score, i) AS o FROM s), q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, x) AS rank FROM b WHERE o = 1)
SELECT q.lang, rank, x AS phrase, a, l, r, n, score FROM q JOIN t ON t.lang = q.lang WHERE rank <= 2000"""

OP12 = """WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) AS x(h, q, v)),
f AS (SELECT page_id, concat(h, q) AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h) + length(q) DESC) AS o FROM p JOIN r ON (host = h OR host LIKE '%.' || h) AND starts_with(path, q))
SELECT p.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN f ON f.page_id = p.page_id AND o = 1"""

# The crc32 of each id is taken bit by bit; a node is known by the texts of its turns' digests.
OP13 = """WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place, md5(concat(md5(coalesce(role, '')), md5(coalesce(text, '')))) AS m, strlen(coalesce(text, '')) AS b FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, count(*) AS n FROM t GROUP BY 1), k AS (SELECT conv_id, s, 0 AS step, CAST(4294967295 AS BIGINT) AS r FROM i
 UNION ALL SELECT conv_id, s, step + 1, xor(x >> 1, 3988292384 * (x & 1)) FROM (SELECT conv_id, s, step, CASE WHEN step % 8 = 0 THEN xor(r, CAST(ascii(substring(s, step // 8 + 1, 1)) AS BIGINT)) ELSE r END AS x FROM k WHERE step < 8 * length(s))),
h AS (SELECT k.conv_id, (4294967295 - r) % 9 AS h, k.conv_id - k.conv_id % 5 AS base FROM k WHERE step = 8 * length(s)), g AS (SELECT h.*, least(h, coalesce(n, 0)) AS taken FROM h LEFT JOIN i ON i.conv_id = h.base),
u AS (SELECT g.conv_id, place + 1 AS d, m, b FROM g JOIN t ON t.conv_id = g.base AND place < h UNION ALL SELECT g.conv_id, place - h + taken + 1, m, b FROM g JOIN t ON t.conv_id = g.conv_id AND place >= h),
p AS (SELECT conv_id, d, b, string_agg(m, '') OVER (PARTITION BY conv_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS x FROM u UNION ALL SELECT conv_id, 0, 0, '' FROM i), l AS (SELECT conv_id, max(d) AS len FROM p GROUP BY 1),
n AS (SELECT x, d, min(p.conv_id) AS conv_id, count(*) AS n_convs, max(b) AS b, coalesce(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (WHERE len = d), '') AS ends FROM p JOIN l ON l.conv_id = p.conv_id GROUP BY 1, 2),
c AS (SELECT left(x, (d - 1) * 32) AS x, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2), w AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c ON c.d = n.d AND c.x = n.x),
s AS (SELECT a.x, a.d, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.b) AS saved FROM w a JOIN w b ON starts_with(b.x, a.x) GROUP BY 1, 2)
SELECT w.conv_id, CAST(w.d AS BIGINT) AS depth, q.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(w.ends) AS ends_sha256
FROM w JOIN s ON s.d = w.d AND s.x = w.x LEFT JOIN n q ON q.d = w.d - 1 AND q.x = left(w.x, (w.d - 1) * 32)"""
