"""SQL that DuckDB runs for operators over whole tables: slow, plain, and by other means than the operators."""

#: Windows of 50 words by their MD5, each word of a window that starts in a smaller document removed.
OP3_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT r, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE doc_id IS NOT NULL)),
m AS (SELECT h, min(doc_id) AS first FROM s GROUP BY h),
g AS (SELECT s.r, s.i FROM s JOIN m ON m.h = s.h WHERE s.doc_id > m.first),
c AS (SELECT DISTINCT r, i + k AS p FROM g, (SELECT unnest(range(50)) AS k)),
l AS (SELECT r, list(p) AS gone FROM c GROUP BY r),
f AS (SELECT d.doc_id, len(w) AS n, CASE WHEN l.gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(l.gone, i)) END AS k FROM d LEFT JOIN l ON l.r = d.r)
SELECT doc_id, n::BIGINT AS n_words, (n - len(k))::BIGINT AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM f
"""

#: Every string of 400 bytes by its MD5; runs of starts that occur twice, merged to maximal spans.
OP7_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
s AS (SELECT r, i, md5_number_lower(substr(h, 2 * i + 1, 800)) AS x FROM (SELECT r, h, unnest(range(n - 399)) AS i FROM d WHERE n >= 400 AND doc_id IS NOT NULL)),
m AS (SELECT x FROM s GROUP BY x HAVING count(*) > 1),
g AS (SELECT r, i, i - row_number() OVER (PARTITION BY r ORDER BY i) AS grp FROM s SEMI JOIN m ON m.x = s.x),
q AS (SELECT r, min(i) AS a, max(i) + 400 AS b FROM g GROUP BY r, grp),
t AS (SELECT r, a, b, max(b) OVER (PARTITION BY r ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM q),
v AS (SELECT r, a, b, count(*) FILTER (e IS NULL OR a > e) OVER (PARTITION BY r ORDER BY a) AS k FROM t),
u AS (SELECT r, k, min(a) AS a, max(b) AS b FROM v GROUP BY r, k),
l AS (SELECT r, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, sum(b - a) AS gone, count(*) AS spans FROM u GROUP BY r),
f AS (SELECT d.doc_id, d.n, coalesce(gone, 0) AS gone, coalesce(spans, 0) AS spans, CASE WHEN l.r IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(l.a) + 1), lambda i: substr(h, 2 * (CASE WHEN i = 0 THEN 0 ELSE l.b[i] END) + 1, 2 * ((CASE WHEN i = len(l.a) THEN d.n ELSE l.a[i + 1] END) - (CASE WHEN i = 0 THEN 0 ELSE l.b[i] END)))), '') END AS kept FROM d LEFT JOIN l ON l.r = d.r)
SELECT doc_id, n::BIGINT AS n_bytes, gone::BIGINT AS n_removed, spans::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM f
"""

#: Shared shingles counted for each pair of documents whose sizes allow it; the smallest reachable id by recursion.
OP10_SQL = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT r, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM d),
e AS (SELECT r, doc_id, len(s) AS n, md5_number_lower(unnest(s)) AS x FROM s),
p AS (SELECT a.r AS a, b.r AS b, any_value(a.doc_id) AS i, any_value(b.doc_id) AS j, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.r < b.r WHERE a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
k AS (SELECT i, j FROM p WHERE 100 * c >= 80 * (n + m - c) UNION SELECT j, i FROM p WHERE 100 * c >= 80 * (n + m - c)),
up AS (SELECT DISTINCT i AS doc_id, i AS low FROM k UNION SELECT k.j, up.low FROM up JOIN k ON k.i = up.doc_id AND up.low < k.j),
c AS (SELECT doc_id, min(low) AS low FROM up GROUP BY doc_id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(c.low, s.doc_id) AS component_id, coalesce(s.doc_id = coalesce(c.low, s.doc_id), true) AS kept FROM s LEFT JOIN c ON c.doc_id = s.doc_id
"""
