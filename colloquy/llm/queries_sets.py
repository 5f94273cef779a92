"""Queries that compare documents with each other or with a benchmark."""

from __future__ import annotations

from . import decontaminate, neardup, substring
from .common import table
from .registry import query

OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 5
      THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
      WHEN len(w) > 0 THEN [len(w) || ':' || array_to_string(w, ' ')] ELSE [] END) AS g FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, other) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY 1) c ON c.doc_id = d.doc_id
"""


@query("op8_near_duplicates", OP8_SQL)
def op8(spark, folder):
    return neardup.near_duplicates(table(spark, folder, "documents"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, unnest(list_transform(range(1, len(w) - 11),
    lambda i: array_to_string(w[i:i+12], ' '))) AS g FROM d),
m AS (SELECT g, min(doc_id) AS least FROM s GROUP BY 1),
c AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM (
    SELECT s.doc_id, s.i FROM s JOIN m ON s.g = m.g WHERE s.doc_id > m.least)),
r AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY 1),
k AS (
  SELECT d.doc_id, len(w) AS n, coalesce(len(gone), 0) AS x, array_to_string(CASE WHEN gone IS NULL THEN w
    ELSE list_filter(w, lambda v, i: NOT list_contains(gone, i)) END, ' ') AS t
  FROM d LEFT JOIN r ON d.doc_id = r.doc_id)
SELECT doc_id, n::BIGINT AS n_words, x::BIGINT AS n_removed, sha256(t) AS kept_sha256 FROM k
"""


@query("op2_substring_dedup", OP2_SQL)
def op2(spark, folder):
    return substring.remove_repeats(table(spark, folder, "documents")).drop("kept_text")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')),
    '[\x20\x09-\x0D.,;:!?"''()\[\]{}«»“”„…]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')),
    '[\x20\x09-\x0D.,;:!?"''()\[\]{}«»“”„…]+'), lambda x: x <> '') AS v FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM d),
bw AS (SELECT item_id, len(v) AS n, unnest(v) AS t, generate_subscripts(v, 1) AS j FROM b WHERE len(v) >= 5),
g AS (
  SELECT doc_id, item_id, n, i - j AS shift, list(j) AS js FROM dw JOIN bw ON dw.t = bw.t
  GROUP BY 1, 2, 3, 4 HAVING count(*) * 13 >= least(13, n) * 10),
o AS (
  SELECT doc_id, item_id, least(13, n) AS size, list_max(list_transform(js, lambda x: len(list_filter(js, lambda y:
    y >= least(x, n - least(13, n) + 1) AND y < least(x, n - least(13, n) + 1) + least(13, n))))) AS same FROM g),
f AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, max(same) AS best FROM o WHERE same * 13 >= size * 10 GROUP BY 1)
SELECT d.doc_id, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(best, 0)::INT AS best_overlap, n_items IS NOT NULL AS contaminated
FROM d LEFT JOIN f ON d.doc_id = f.doc_id
"""


@query("op3_decontamination", OP3_SQL)
def op3(spark, folder):
    rows = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return rows.select("doc_id", "n_items", "best_overlap", "contaminated")
