"""A corpus from raw documents to tokens: language, lines, near copies, benchmark items, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.llm import bpe, decontam, langid, linededup, queries, setjoin
from driftlens.llm.workspace import Workspace

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents whose best language has a lower mean marginal, or that have none, go.
MIN_LANGUAGE_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language that the model is sure enough of."""
    docs = docs.select(*COLUMNS)
    return langid.accepted(docs, langid.fit(docs), MIN_LANGUAGE_SCORE)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that an earlier document holds; n_chars follows the text."""
    out = linededup.dedup_lines(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, keep the one with the smallest id."""
    dropped = setjoin.similar_documents(docs).where(F.col("component_id") != F.col("doc_id")).select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti").select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontam.clean_documents(docs, queries.table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode what is left."""
    return bpe.encode_documents(docs, *queries.tokenizer())


STAGES = [("language ID", language), ("line dedup", lines), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", benchmark), ("byte-level BPE", tokens)]

#: Language ID and tokens are not expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each one's result is a written table before the next reads it."""
    space = Workspace(spark, "pipeline")
    docs = queries.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = space.keep(stage(spark, docs, sf_dir), f"stage{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
