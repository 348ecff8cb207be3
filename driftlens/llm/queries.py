"""The llm queries of ``__spark_entry__`` and their SQL; all read whole tables."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.llm import bpe, curriculum, decontam, deltalloyd, langid, linededup, oracles, pii, quality, quotes, setjoin, sufdedup, turnscan, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> tuple[str, str]:
    """Default vocabulary file and pre-token pattern; both are parameters of the operator."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


#: The session's key of surrogates. Without it each run draws one that nobody keeps.
PII_KEY = "spark.driftlens.pii.key"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), spark.conf.get(PII_KEY, None) or secrets.token_hex(32))


def op2_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.reply_ordered(table(spark, sf_dir, "conversations"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sufdedup.remove_repeats(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), *tokenizer())


def op7_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.similar_documents(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs)).withColumn("held_out", langid.held_out("doc_id"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op11_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deltalloyd.described(*deltalloyd.cluster(table(spark, sf_dir, "embeddings")))


def op12_turn_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turnscan.report(table(spark, sf_dir, "conversations"))


def op13_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.taken_words(curriculum.training_order(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii, "op2_quotes": op2_quotes, "op6_suffix_dedup": op6_suffix_dedup,
    "op3_quality": op3_quality, "op4_warc": op4_warc, "op5_bpe": op5_bpe, "op7_set_join": op7_set_join,
    "op8_decontaminate": op8_decontaminate, "op9_language": op9_language, "op10_line_dedup": op10_line_dedup,
    "op11_delta_lloyd": op11_delta_lloyd, "op12_turn_scan": op12_turn_scan, "op13_curriculum": op13_curriculum,
}

_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

OP10_SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
k AS (SELECT *, translate(trim(line, {_WHITE}), {_UPPER}, {_LOWER}) AS key FROM l),
f AS (SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) <> max(doc_id)),
d AS (SELECT k.*, f.first_doc IS NOT NULL AND f.first_doc <> k.doc_id AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id"""

OP7_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(root) FROM r WHERE r.doc_id = d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id"""

# Messages are told apart by conversation and turn here, as in the tables given.
OP2_SQL = r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM m),
v AS (SELECT *, length(regexp_replace(regexp_extract(line, '^((?:[ \t]*>)+)[ \t]?', 1), '[^>]', '', 'g')) AS level,
      trim(regexp_replace(lower(regexp_replace(line, '^((?:[ \t]*>)+)[ \t]?', '')), '[ \t\n\x0b\f\r]+', ' ', 'g')) AS said FROM l),
o AS (SELECT conv_id, turn, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE level = 0), ''), '^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$', '', 'g') AS own,
      coalesce(list(said ORDER BY pos) FILTER (WHERE level = 0 AND said <> ''), []) AS lines FROM v GROUP BY conv_id, turn),
b AS (SELECT *, level <> lag(level, 1, -1) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS new FROM v),
r AS (SELECT *, sum(new::int) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS run FROM b),
q AS (SELECT conv_id, turn, run, level, coalesce(list(said ORDER BY pos) FILTER (WHERE said <> ''), []) AS lines FROM r WHERE level > 0 GROUP BY conv_id, turn, run, level),
p AS (SELECT *, array_to_string(lines, ' ') AS passage, len(lines) AS size FROM q WHERE len(lines) > 0),
sizes AS (SELECT DISTINCT size FROM p),
s AS (SELECT DISTINCT conv_id, turn, array_to_string(lines[i + 1 : i + size], ' ') AS passage
      FROM (SELECT o.*, size, unnest(range(0, len(lines) - size + 1)) AS i FROM o JOIN sizes ON size <= len(lines))),
here AS (SELECT p.conv_id, p.turn, p.run, min(s.turn) AS t FROM p JOIN s ON s.passage = p.passage AND s.conv_id = p.conv_id GROUP BY ALL),
there AS (SELECT p.conv_id, p.turn, p.run, min(s.conv_id) AS c FROM p JOIN s ON s.passage = p.passage AND s.conv_id <> p.conv_id GROUP BY ALL),
k AS (SELECT p.conv_id, p.turn, p.level, CASE WHEN here.t < p.turn THEN here.t END AS t, coalesce(here.t < p.turn, false) OR there.c IS NOT NULL AS linked
      FROM p LEFT JOIN here USING (conv_id, turn, run) LEFT JOIN there USING (conv_id, turn, run)),
n AS (SELECT conv_id, turn, count(*) AS n_quotes, count(*) FILTER (WHERE linked) AS n_linked, arg_min(t, level * 1e9 - t) FILTER (WHERE t IS NOT NULL) AS reply_to FROM k GROUP BY conv_id, turn),
t AS (SELECT conv_id, turn, turn AS thread, 0 AS depth FROM o LEFT JOIN n USING (conv_id, turn) WHERE reply_to IS NULL
      UNION ALL SELECT n.conv_id, n.turn, t.thread, t.depth + 1 FROM n JOIN t ON n.conv_id = t.conv_id AND n.reply_to = t.turn)
SELECT m.conv_id, row_number() OVER (PARTITION BY m.conv_id ORDER BY t.thread, m.turn) - 1 AS position, m.turn, m.role, o.own AS text,
       coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked, reply_to, t.thread, t.depth
FROM m JOIN o USING (conv_id, turn) JOIN t USING (conv_id, turn) LEFT JOIN n USING (conv_id, turn)"""

ORACLE_SQL: dict[str, str] = {"op2_quotes": OP2_SQL, "op7_set_join": OP7_SQL, "op10_line_dedup": OP10_SQL,
                              "op11_delta_lloyd": oracles.OP11_SQL, "op12_turn_scan": oracles.OP12_SQL, "op13_curriculum": oracles.OP13_SQL}
