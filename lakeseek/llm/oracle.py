"""SQL that says the same as the queries of this subpackage, where SQL can."""

W = "[^\\x20\\x09-\\x0D]+"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, '{W}') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w WHERE len(w) > 1)
      UNION ALL SELECT doc_id, w[1] FROM w WHERE len(w) = 1),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
b AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT b.a, b.b FROM b JOIN n x ON x.doc_id = b.a JOIN n y ON y.doc_id = b.b WHERE 100 * b.k >= 60 * (x.n + y.n - b.k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
s AS (SELECT a, count(*) AS k FROM e GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(s.k, 0) AS n_similar, c.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN s ON s.a = d.doc_id JOIN c ON c.a = d.doc_id
"""

OP4 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{W}') AS w FROM d),
k AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) > 4)),
m AS (SELECT k.doc_id, k.i FROM k JOIN (SELECT doc_id, k FROM k GROUP BY doc_id, k HAVING count(*) > 1) t ON t.doc_id = k.doc_id AND t.k = k.k),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, i + unnest([0, 1, 2, 3, 4]) AS p FROM m) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{W}') GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, w, unnest(range(2, len(w) + 1)) AS i FROM w WHERE len(w) > 1) WHERE w[i] = w[i - 1] GROUP BY doc_id),
c AS (SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(coalesce(l.dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, coalesce(l.n, 0) AS n_lines, coalesce(s.n, 0) AS stutter,
      length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS upper, length(text) - length(regexp_replace(text, '[a-z]', '', 'g')) AS lower, length(text) - length(replace(text, '!', '')) AS bangs
      FROM w LEFT JOIN l ON l.doc_id = w.doc_id LEFT JOIN r ON r.doc_id = w.doc_id LEFT JOIN s ON s.doc_id = w.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
NOT (base_failed OR 10 * stutter > 3 * n_words OR 10 * n_symbols > 3 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR (2 * n_dup_lines > n_lines AND n_dup_lines >= 3) OR upper > lower OR 10 * bangs > 5 * n_words) AS kept
FROM b
"""

OP5 = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{W}')) AS BIGINT) AS size, md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS w FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY source_size * 2.0::DOUBLE / w, source NULLS LAST) AS i, source_size * 2.0::DOUBLE / w AS ratio FROM s),
p AS (SELECT *, (SELECT 1.5::DOUBLE * sum(source_size) FROM s) - 2.0::DOUBLE * (sum(source_size) OVER (ORDER BY i) - source_size) AS rest, (sum(w) OVER ()) - (sum(w) OVER (ORDER BY i)) + w AS left_w FROM o),
f AS (SELECT rest, left_w FROM p WHERE rest / left_w <= ratio ORDER BY i LIMIT 1),
t AS (SELECT p.source, p.source_size, CASE WHEN f.rest * p.w / f.left_w > 2.0::DOUBLE * p.source_size THEN 2.0::DOUBLE * p.source_size ELSE f.rest * p.w / f.left_w END AS target FROM p, f),
q AS (SELECT d.doc_id, d.size, t.source_size, t.target, least(floor(t.target + 0.5), 2 * t.source_size) AS flow,
      2 * (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size) - d.size) + d.size AS mid FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target, CAST((CASE WHEN mid <= 2 * flow THEN 1 ELSE 0 END) + (CASE WHEN mid <= 2 * (flow - source_size) THEN 1 ELSE 0 END) AS INTEGER) AS copies,
CAST(size * ((CASE WHEN mid <= 2 * flow THEN 1 ELSE 0 END) + (CASE WHEN mid <= 2 * (flow - source_size) THEN 1 ELSE 0 END)) AS BIGINT) AS taken FROM q
"""

_ALNUM = "[0-9a-z\\x{80}-\\x{10FFFF}]+"

OP10 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_ALNUM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOW}, '{_ALNUM}') AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS k, least(len(w), 10) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM v),
x AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT d.doc_id, d.w, n.n, unnest(range(1, len(d.w) - n.n + 2)) AS i FROM d, n WHERE len(d.w) >= n.n)),
h AS (SELECT x.doc_id, x.i, x.n, v.item_id FROM x JOIN v ON v.k = x.k AND v.n = x.n),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i + unnest(range(0, n)) AS p FROM h) GROUP BY doc_id),
j AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(j.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(j.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN j ON j.doc_id = d.doc_id
"""
