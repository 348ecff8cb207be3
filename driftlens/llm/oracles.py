"""SQL for the queries of operators 11 to 13, put together from parts that repeat."""

from __future__ import annotations

# --- op11: every round compares all vectors with all centroids --------------------------------------------------------


def _round(k: int) -> str:
    return f"""a{k} AS MATERIALIZED (
  SELECT vec_id, c, d FROM (SELECT vec_id, c, d, row_number() OVER (PARTITION BY vec_id ORDER BY d, c) AS place
    FROM (SELECT e.vec_id, m.c, sum((e.x - m.x) * (e.x - m.x)) AS d FROM e JOIN c{k} m ON e.pos = m.pos GROUP BY e.vec_id, m.c)) WHERE place = 1)"""


def _centroids(k: int) -> str:
    return f"""s{k} AS (SELECT a.c, e.pos, sum(e.x) AS s, count(*) AS n FROM a{k - 1} a JOIN e ON e.vec_id = a.vec_id GROUP BY a.c, e.pos),
c{k} AS MATERIALIZED (SELECT m.c, m.pos, CASE WHEN s.n IS NULL THEN m.x ELSE ((s.s - ((s.s % s.n) + s.n) % s.n) // s.n)::bigint END AS x FROM c{k - 1} m LEFT JOIN s{k} s ON s.c = m.c AND s.pos = m.pos)"""


ROUNDS = 10
OP11_SQL = """WITH kept AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
e AS MATERIALIZED (SELECT vec_id, generate_subscripts(embedding, 1) AS pos, floor(1024 * unnest(embedding)::double)::bigint AS x FROM kept),
f AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c FROM kept),
c0 AS MATERIALIZED (SELECT f.c, e.pos, e.x FROM f JOIN e USING (vec_id) WHERE f.c < 8),
""" + ",\n".join([_round(0)] + [f"{_centroids(k)},\n{_round(k)}" for k in range(1, ROUNDS + 1)]) + f""",
h AS (SELECT c, sha256(string_agg(x::varchar, ',' ORDER BY pos)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c)
SELECT vec_id, c::int AS cluster, d::bigint AS distance, (sum(d) OVER (PARTITION BY c))::bigint AS cluster_inertia, (sum(d) OVER ())::bigint AS inertia, centroid_sha256
FROM a{ROUNDS} JOIN h USING (c)"""

# --- op12: turn by turn over the four states ----------------------------------------------------------------------------


def _plus(way: str, cost: str, edit: str) -> str:
    return f"CASE WHEN {way} IS NOT NULL THEN struct_pack(c := {way}.c + {cost}, a := {way}.a || {edit}) END"


def _least(*ways: str) -> str:
    return f"list_min(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))"


_ENTRY = "STRUCT(c BIGINT, a VARCHAR)"
_GIVE = [_plus("p.w", f"(CASE WHEN t.initial = '{i}' THEN 0 ELSE 2 END + t.truncated::int)", f"CASE WHEN t.initial = '{i}' THEN 'K' ELSE 'R' END") for i in "ua"]
_STEP = f"""SELECT p.conv, p.i, {_plus('s0', '3', "'D'")} AS n0,
  {_least(_plus('s1', '3', "'D'"), f"CASE WHEN NOT gone AND initial = 's' THEN {_plus('s0', 'truncated::int', chr(39) + 'K' + chr(39))} END")} AS n1,
  {_least(_plus('s2', '3', "'D'"), 'CASE WHEN NOT gone THEN ' + _plus('w2', "(CASE WHEN initial = 'u' THEN 0 ELSE 2 END + truncated::int)", "CASE WHEN initial = 'u' THEN 'K' ELSE 'R' END") + ' END')} AS n2,
  {_least(_plus('s3', '3', "'D'"), 'CASE WHEN NOT gone THEN ' + _plus('s2', "(CASE WHEN initial = 'a' THEN 0 ELSE 2 END + truncated::int)", "CASE WHEN initial = 'a' THEN 'K' ELSE 'R' END") + ' END')} AS n3
  FROM (SELECT conv, i + 1 AS i, s0, s1, s2, s3, {_least('s0', 's1', 's3')} AS w2 FROM walk) p JOIN t ON t.conv = p.conv AND t.i = p.i"""
_KEY = "coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')"
_CRC = f"xor(list_reduce([4294967295::bigint] || list_transform(string_split({_KEY}, ''), lambda x: ord(x)::bigint), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"

OP12_SQL = rf"""WITH RECURSIVE g AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} % 20 AS draw FROM conversations),
x AS (SELECT coalesce(conv_id::varchar, ' ') AS conv, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
      CASE WHEN draw = 1 THEN '' WHEN draw = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN draw = 3 THEN [0, 1] ELSE [0] END) AS copy FROM g WHERE draw <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS i, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS fin FROM x),
b AS (SELECT *, fin = '' AS blank, fin <> '' AND row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 AS duplicate FROM o),
t AS (SELECT *, left(role, 1) AS initial, blank OR duplicate AS gone, NOT blank AND NOT duplicate AND fin NOT IN ('.', '!', '?') AS truncated, lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY i) || left(role, 1) AS pair FROM b),
walk AS (
  SELECT conv, 0::bigint AS i, struct_pack(c := 0::bigint, a := '') AS s0, NULL::{_ENTRY} AS s1, struct_pack(c := 2::bigint, a := 'I') AS s2, struct_pack(c := 4::bigint, a := 'II') AS s3 FROM (SELECT DISTINCT conv FROM t)
  UNION ALL
  SELECT conv, i, n0, n1, {_least('n2', _plus('n0', '2', "'I'"), _plus('n1', '2', "'I'"), _plus('n3', '2', "'I'"))}, {_least('n3', _plus('n2', '2', "'I'"), _plus('n0', '4', "'II'"), _plus('n1', '4', "'II'"))}
  FROM ({_STEP})),
n AS (SELECT conv, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
      count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM t GROUP BY conv),
z AS (SELECT w.conv, {_least('s0', 's3')} AS way FROM walk w JOIN n ON w.conv = n.conv AND w.i = n.n),
l AS (SELECT conv, generate_subscripts(string_split(way.a, ''), 1) AS k, unnest(string_split(way.a, '')) AS edit FROM z WHERE way.a <> ''),
m AS (SELECT *, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv ORDER BY k) AS i, count(*) FILTER (edit <> 'D') OVER (PARTITION BY conv ORDER BY k) - 1 AS place FROM l),
r AS (SELECT m.*, t.role AS old, t.text AS said, t.initial FROM m LEFT JOIN t ON t.conv = m.conv AND t.i = m.i AND m.edit <> 'I' WHERE m.edit <> 'D'),
q AS (SELECT *, coalesce(bool_or(place = 0 AND edit = 'K' AND initial = 's') OVER (PARTITION BY conv), false) AS led FROM r),
y AS (SELECT conv, sha256(string_agg(CASE WHEN edit = 'K' THEN old WHEN (place + led::int) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || coalesce(said, ''), chr(10) ORDER BY k)) AS repaired_sha256 FROM q GROUP BY conv)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(z.way.c, 0) AS cost, coalesce(z.way.a, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN n ON n.conv = coalesce(d.conv_id::varchar, ' ') LEFT JOIN z ON z.conv = n.conv LEFT JOIN y ON y.conv = n.conv"""

# --- op13: the water level from the sources in the order in which they fill up ---------------------------------------------

OP13_SQL = r"""WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint AS size, md5('13:' || coalesce(doc_id::varchar, '')) AS draw, row_number() OVER () AS tie FROM documents),
w AS (SELECT source, sum(size)::bigint AS source_size, [3.0::double, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM s GROUP BY source),
f AS (SELECT *, 2.0::double * source_size / w AS full_at, row_number() OVER (ORDER BY 2.0::double * source_size / w, source NULLS LAST) AS k FROM w),
l AS (SELECT *, (1.5::double * sum(source_size) OVER () - 2.0::double * coalesce(sum(source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
v AS (SELECT arg_min(level, k) FILTER (2.0::double * source_size >= w * level) AS level FROM l),
t AS (SELECT source, source_size, least(2.0::double * source_size, w * v.level) AS target FROM l, v),
p AS (SELECT s.*, source_size, target, least(round(target)::bigint, 2 * source_size) AS give,
      coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY draw, size, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS before
      FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, greatest(least(give - before, size), 0) + greatest(least(give - source_size - before, size), 0) AS taken FROM p"""
