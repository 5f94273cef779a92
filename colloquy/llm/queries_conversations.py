"""Queries on conversations."""

from __future__ import annotations

from . import repair, trie
from .common import table
from .registry import query

# Entry i is the rest of byte i.
CRC_TABLE = """crc_table AS (
  SELECT list(v ORDER BY i) AS crc_rest FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b:
      CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
    FROM (SELECT unnest(range(0, 256)) AS i)))"""


def crc_sql(ascii_text: str) -> str:
    """crc32 of a text of ASCII characters; `crc_table` has to be joined."""
    return f"""xor(4294967295, list_reduce(list_transform(range(1, length({ascii_text}) + 1), lambda i: ord(substr({ascii_text}, i::INT, 1))::BIGINT),
      lambda c, b: xor(c >> 8, crc_rest[(xor(c, b) & 255) + 1]), 4294967295))"""


OP11_SQL = f"""
WITH {CRC_TABLE},
o AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS t, turn FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, list(struct_pack(r := r, t := t) ORDER BY turn NULLS FIRST, r, md5(length(r) || ':' || r || t)) AS l
  FROM o GROUP BY 1),
h AS (SELECT conv_id, l, {crc_sql('conv_id::VARCHAR')} % 6 AS h FROM c, crc_table),
r AS (
  SELECT a.conv_id, list_concat(coalesce(b.l[1:a.h], []), a.l[a.h + 1:]) AS l
  FROM h a LEFT JOIN c b ON b.conv_id = a.conv_id - a.conv_id % 100),
n AS (
  SELECT l[1:d] AS k, d, min(conv_id) AS conv_id, count(*) AS n,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(l) = d), '') AS e
  FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM r) GROUP BY 1, 2),
f AS (SELECT k[1:d - 1] AS k, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
w AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.d > 0 THEN (n - 1) * length(n.k[n.d].t) ELSE 0 END AS saved
  FROM n LEFT JOIN f ON n.k = f.k AND n.d = f.d),
s AS (
  SELECT k[1:u] AS k, u AS d, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved
  FROM (SELECT k, n_children, saved, unnest(range(0, d + 1)) AS u FROM w) GROUP BY 1, 2)
SELECT w.conv_id::BIGINT AS conv_id, w.d::BIGINT AS depth, p.conv_id::BIGINT AS parent_conv_id, w.n::BIGINT AS n_convs,
  w.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(w.e) AS ends_sha256
FROM w JOIN s ON s.k = w.k AND s.d = w.d LEFT JOIN n p ON w.d > 0 AND p.d = w.d - 1 AND p.k = w.k[1:w.d - 1]
"""


@query("op11_prefix_trie", OP11_SQL)
def op11(spark, folder):
    return trie.prefix_trie(table(spark, folder, "conversations"))


def _add(b: str, cost: str, label: str, line: str) -> str:
    """A walk (cost, audit, text) with one more edit."""
    return f"CASE WHEN {b} IS NOT NULL THEN struct_pack(c := {b}.c + {cost}, a := {b}.a || '{label}', t := {b}.t || {line}) END"


def _least(*walks: str) -> str:
    return f"list_sort(list_filter([{', '.join(walks)}], lambda x: x IS NOT NULL))[1]"


def _inserted(source: str) -> str:
    """Walks n0 to n3 of `source` after inserts, as b0 to b3."""
    b2 = _least("n2", *[_add(f"n{s}", "3", "I", "chr(10) || 'user:'") for s in (0, 1, 3)])
    b3 = _least("n3", _add("b2", "3", "I", "chr(10) || 'assistant:'"))
    return f"SELECT conv_id, i, n0 AS b0, n1 AS b1, b2, {b3} AS b3 FROM (SELECT *, {b2} AS b2 FROM ({source}))"


_LINE = "chr(10) || role || ':' || text"
_DUE = "chr(10) || '{}:' || text"


def _kept(s: int, initial: str) -> str:
    return f"CASE WHEN stays AND r = '{initial}' THEN {_add(f'b{s}', 'extra', 'K', _LINE)} END"


def _reroled(s: int, role: str) -> str:
    return f"CASE WHEN stays THEN {_add(f'b{s}', '(3 + extra)', 'R', _DUE.format(role))} END"


def _gone(s: int) -> str:
    return _add(f"b{s}", "4", "D", "''")


_ONE_ROW = f"""SELECT dp.conv_id, dp.i + 1 AS i, {_gone(0)} AS n0, {_least(_gone(1), _kept(0, 's'))} AS n1,
    {_least(_gone(2), *[_kept(s, 'u') for s in (0, 1, 3)], *[_reroled(s, 'user') for s in (0, 1, 3)])} AS n2,
    {_least(_gone(3), _kept(2, 'a'), _reroled(2, 'assistant'))} AS n3
  FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.pos = dp.i + 1"""
_NOTHING = "CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR))"

OP13_SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc_sql('name')} % 20 AS k
  FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations), crc_table),
e AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(0, CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM d),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text), copy) AS pos,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM e),
g AS (
  SELECT *, substr(role, 1, 1) AS r, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault FROM o),
f AS (
  SELECT *, fault IN ('', 'truncated') AS stays, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS extra,
    lag(r) OVER (PARTITION BY conv_id ORDER BY pos) || r AS met FROM g),
dp AS (
  {_inserted(f"SELECT conv_id, 0::BIGINT AS i, struct_pack(c := 0::BIGINT, a := '', t := '') AS n0, {_NOTHING} AS n1, {_NOTHING} AS n2, {_NOTHING} AS n3 FROM (SELECT DISTINCT conv_id FROM conversations)")}
  UNION ALL
  {_inserted(_ONE_ROW)}),
w AS (
  SELECT conv_id, i, {_least('b0', 'b3')} AS best, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS from_end FROM dp),
n AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE met NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1)
SELECT w.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, best.c::BIGINT AS cost, best.a AS audit,
  sha256(substr(best.t, 2)) AS repaired_sha256
FROM w LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM w.conv_id WHERE from_end = 1
"""


@query("op13_structure_repair", OP13_SQL)
def op13(spark, folder):
    return repair.repair_conversations(table(spark, folder, "conversations"))
