"""The query over conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .turns import damage, repair_turns


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    repaired = repair_turns(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return repaired.select("*", F.sha2("repaired", 256).alias("repaired_sha256")).drop("repaired")


_STEP = """
    {{'e': {{'c': e.c + 2, 'a': e.a || 'D'}},
      's': list_min([{{'c': s.c + 2, 'a': s.a || 'D'}}, {{'c': CASE WHEN bad OR i != 's' THEN 1000000000000 ELSE e.c + lame END, 'a': e.a || 'K'}}]),
      'u': list_min([{{'c': u.c + 2, 'a': u.a || 'D'}}] || list_transform([e, s, a], lambda x: {{'c': CASE WHEN bad THEN 1000000000000 WHEN i = 'u' THEN x.c + lame ELSE x.c + 1 + lame END, 'a': x.a || CASE WHEN i = 'u' THEN 'K' ELSE 'R' END}})),
      'a': list_min([{{'c': a.c + 2, 'a': a.a || 'D'}}, {{'c': CASE WHEN bad THEN 1000000000000 WHEN i = 'a' THEN u.c + lame ELSE u.c + 1 + lame END, 'a': u.a || CASE WHEN i = 'a' THEN 'K' ELSE 'R' END}}])}}"""

#: Two recursions: one over rows for the cheapest edits, one over their letters for the repaired lines.
ORACLE = f"""
WITH RECURSIVE bytes AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), hashed AS (
  SELECT conv_id, turn, role, text, xor(4294967295, list_reduce([4294967295]::BIGINT[] || list_transform(string_split(k, ''), lambda c: ord(c)::BIGINT), lambda h, b: xor(h >> 8, crc[(xor(h, b) & 255) + 1]))) % 20 AS d
  FROM keyed, bytes
), harmed AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN d = 3 THEN [1, 2] ELSE [1] END) AS copy FROM hashed WHERE d != 0)
), placed AS (
  SELECT *, role[1:1] AS i, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM harmed
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again, lag(i) OVER (PARTITION BY conv_id ORDER BY pos) AS before,
    regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS final FROM placed
), marked AS (
  SELECT *, final = '' AS blank, final != '' AND again AS duplicate, final != '' AND NOT again AND final NOT IN ('.', '!', '?') AS truncated FROM seen
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
    count(*) FILTER (truncated) AS truncated, count(*) FILTER (before || i NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n FROM marked GROUP BY conv_id
), fold(conv_id, pos, e, s, u, a) AS (
  SELECT conv_id, 0::BIGINT, {{'c': 0::BIGINT, 'a': ''}}, {{'c': 1000000000000, 'a': ''}}, {{'c': 5::BIGINT, 'a': 'I'}}, {{'c': 10::BIGINT, 'a': 'II'}} FROM counts
  UNION ALL
  SELECT conv_id, pos, x.e, x.s,
    list_min([x.u] || list_transform([x.e, x.s, x.a], lambda y: {{'c': y.c + 5, 'a': y.a || 'I'}})),
    list_min([x.a, {{'c': x.u.c + 5, 'a': x.u.a || 'I'}}] || list_transform([x.e, x.s], lambda y: {{'c': y.c + 10, 'a': y.a || 'II'}}))
  FROM (SELECT f.conv_id, m.pos, {_STEP.format()} AS x
    FROM fold f JOIN (SELECT conv_id, pos, i, blank OR duplicate AS bad, CASE WHEN truncated THEN 5 ELSE 0 END AS lame FROM marked) m ON f.conv_id IS NOT DISTINCT FROM m.conv_id AND m.pos = f.pos + 1)
), best AS (
  SELECT c.conv_id, list_min([f.e, f.a]) AS x FROM counts c JOIN fold f ON c.conv_id IS NOT DISTINCT FROM f.conv_id AND f.pos = c.n
), replay(conv_id, k, r, last, lines) AS (
  SELECT conv_id, 0, 0::BIGINT, '', '' FROM best
  UNION ALL
  SELECT conv_id, k, r, CASE WHEN l = 'D' THEN last WHEN l = 'K' THEN i ELSE other[1:1] END,
    lines || CASE WHEN l = 'D' THEN '' ELSE CASE WHEN last = '' THEN '' ELSE chr(10) END || CASE l WHEN 'K' THEN role || ':' || text WHEN 'R' THEN other || ':' || text ELSE other || ':' END END
  FROM (SELECT p.conv_id, p.k + 1 AS k, p.r + CASE WHEN p.l = 'I' THEN 0 ELSE 1 END AS r, p.l, p.last, p.lines, m.role, m.text, m.i, CASE WHEN p.last = 'u' THEN 'assistant' ELSE 'user' END AS other
    FROM (SELECT y.*, b.x.a[y.k + 1:y.k + 1] AS l FROM replay y JOIN best b ON y.conv_id IS NOT DISTINCT FROM b.conv_id AND y.k < length(b.x.a)) p
    LEFT JOIN marked m ON p.conv_id IS NOT DISTINCT FROM m.conv_id AND m.pos = p.r + 1)
), told AS (
  SELECT y.conv_id, b.x, y.lines FROM replay y JOIN best b ON y.conv_id IS NOT DISTINCT FROM b.conv_id AND y.k = length(b.x.a)
)
SELECT o.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal,
  coalesce(t.x.c, 0)::BIGINT AS cost, coalesce(t.x.a, '') AS audit, sha256(coalesce(t.lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN told t ON o.conv_id IS NOT DISTINCT FROM t.conv_id
"""

QUERIES = {"op13_turn_repair": op13_turn_repair}
ORACLES = {"op13_turn_repair": ORACLE}
