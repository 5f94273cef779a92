"""Queries on texts one by one and on their order: mixing, cleaning, sharding."""

from __future__ import annotations

from . import mixing, pseudo_lm, quality, sharding, toxicity
from .common import table
from .registry import query

WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

OP4_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
j AS (
  SELECT *, list_transform(string_split(t, chr(10)), lambda l: struct_pack(
    line := l, n := len(list_filter(string_split_regex(l, '[\x20\x09-\x0D]+'), lambda x: x <> '')))) AS ls,
    list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]) AS tri
  FROM d),
g AS (
  SELECT doc_id, rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM (
    SELECT doc_id, rid, unnest(tri) AS g, generate_subscripts(tri, 1) AS i
    FROM (SELECT *, row_number() OVER () AS rid FROM j))),
r AS (
  SELECT doc_id, count(DISTINCT p) AS n_rep FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE c >= 2) GROUP BY 1),
b AS (
  SELECT doc_id, t, w, list_filter(ls, lambda x: x.n > 0) AS wl FROM j),
v AS (
  SELECT *, list_filter(wl, lambda x:
      (x.n >= 4 AND x.n < 16 AND NOT regexp_matches(x.line, '[.!?…:;,]["''”’»)\]]*[\x20\x09-\x0D]*$'))
   OR (100 * (length(x.line) - length(translate(x.line, '#*$%&|<>', ''))) > 10 * length(x.line))
   OR (x.n >= 4 AND 100 * len(list_filter(string_split_regex(x.line, '[\x20\x09-\x0D]+'),
         lambda q: regexp_full_match(q, '[^\x20\x09-\x0D]*!!+|[\p{{Lu}}]{{2,}}[.,;:]*'))) > 60 * x.n)
   OR (100 * len(list_filter(string_split_regex(x.line, '[\x20\x09-\x0D]+'),
         lambda q: regexp_full_match(q, '[|»›>•·]+'))) > 20 * x.n)
   OR regexp_matches(x.line, '(?i)\b(all rights reserved|terms of use|terms of service|privacy policy|cookie policy|accept cookies|subscribe to our newsletter|skip to content|skip to main content|lorem ipsum|enable javascript)\b')
  ) AS badl FROM b),
f AS (
  SELECT v.doc_id, len(w) AS n_words,
    length(array_to_string(w, '')) AS word_chars,
    length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
    len(wl) - len(list_distinct(list_transform(wl, lambda x: x.line))) AS n_dup_lines,
    coalesce(n_rep, 0) AS n_repeat_words,
    coalesce(list_sum(list_transform(badl, lambda x: x.n)), 0) AS lost
  FROM v LEFT JOIN r ON v.doc_id = r.doc_id)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost <= 50 * n_words AS kept
FROM f
"""


@query("op4_line_quality", OP4_SQL)
def op4(spark, folder):
    rows = quality.judge_lines(table(spark, folder, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                       "n_repeat_words", "base_failed", "kept")


@query("op6_minimax_shards")
def op6(spark, folder):
    rows = sharding.shard_documents(table(spark, folder, "documents"))
    return rows.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


OP1_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce('s' || source, '') AS key, len({WORDS})::BIGINT AS size,
    ('0x' || substr(md5('7:' || coalesce('s' || doc_id::VARCHAR, '')), 1, 12))::BIGINT
      % (SELECT greatest(1, round(sqrt(count(*))))::BIGINT FROM documents) AS bucket
  FROM documents),
s AS (SELECT source, key, sum(size)::BIGINT AS source_size FROM d GROUP BY 1, 2),
w AS (
  SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight,
    3 * source_size AS lim, sum(source_size) OVER () AS total FROM s),
l AS (
  SELECT *, (total - coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (
  SELECT source, key, source_size, total::BIGINT AS total,
    least(lim::DOUBLE, (SELECT level FROM l WHERE lim >= level * weight
                        ORDER BY lim / weight, level LIMIT 1) * weight) AS target FROM l),
b AS (
  SELECT *, greatest(1, least(1024, total // 4096))::BIGINT AS block,
    count(*) OVER () AS n_sources FROM t),
h AS (
  SELECT *, ceil(source_size / block)::BIGINT AS m, round(total / block)::BIGINT AS seats FROM b),
q AS (
  SELECT key, target, unnest(range(1, (3 * m + 1)::BIGINT)) AS k FROM h),
a AS (
  SELECT key, count(*) AS draws FROM (
    SELECT key, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, key = '', key, k) AS place FROM q)
  WHERE place <= (SELECT max(seats) FROM h) GROUP BY 1),
p AS (
  SELECT d.doc_id, d.size, h.source_size, h.target, h.block, greatest(h.m, 1) AS m, coalesce(a.draws, 0) AS draws,
    (sum(d.size) OVER (PARTITION BY d.key ORDER BY bucket, doc_id, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size)::BIGINT AS start
  FROM d JOIN h ON d.key = h.key LEFT JOIN a ON d.key = a.key),
x AS (
  SELECT *, CASE WHEN m % 160481183 <> 0 THEN 160481183 ELSE 104395301 END AS step FROM p)
SELECT doc_id, size, source_size, target,
  CASE WHEN size = 0 THEN 0 ELSE list_sum(list_transform(range(start // block, (start + size - 1) // block + 1),
    lambda k: (draws // m + CASE WHEN (k * step + 55433) % m < draws % m THEN 1 ELSE 0 END)
      * (least(start + size, (k + 1) * block) - greatest(start, k * block)))) END::BIGINT AS taken
FROM x
"""


@query("op1_source_mix", OP1_SQL)
def op1(spark, folder):
    rows = mixing.mix_words(table(spark, folder, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


@query("op10_toxicity")
def op10(spark, folder):
    docs = table(spark, folder, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, folder, "labels")))


@query("op7_pseudo_likelihood")
def op7(spark, folder):
    docs = table(spark, folder, "documents")
    words = pseudo_lm.count_words(docs)
    return pseudo_lm.score(docs, pseudo_lm.train(docs, words=words), words)
