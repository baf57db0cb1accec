"""SQL twins of operators that SQL can express by plain joins over all windows or shingles."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"coalesce(regexp_extract_all(" + _LOWER.format("text") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

DECONTAMINATION_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, array_to_string(w[i + 1:i + 13], ' ') AS k, least(len(w), 13) AS n FROM b, range(greatest(len(w) - 12, 1)) t(i) WHERE len(w) > 0),
l AS (SELECT DISTINCT n FROM p),
x AS (SELECT r, i, n, array_to_string(w[i + 1:i + n], ' ') AS k FROM d, l, range(greatest(len(w) - n + 1, 0)) t(i)),
h AS (SELECT r, i, x.n, item_id FROM x JOIN p ON x.k = p.k AND x.n = p.n),
c AS (SELECT r, count(DISTINCT j) AS n_hit FROM h, range(i, i + n) u(j) GROUP BY r),
s AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN s USING (r)
"""

NEAR_DUPLICATES_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER.format("text")}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 5], ' ') AS g FROM d, range(greatest(len(w) - 4, 1)) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
k AS (SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
t AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT t.a, k.b FROM t JOIN k ON t.b = k.a)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(t.b) AS component_id
FROM d JOIN t ON t.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
