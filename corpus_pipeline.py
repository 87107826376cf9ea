"""Corpus pipeline: quality, lines, near-duplicates, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before has kept. All but the
last return the columns of ``documents``. Nulls, empty texts and repeated rows are handled as the
operators' docstrings say; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semgraph.llm import benchmark, lines, pieces, quality, simhash
from semgraph.llm.common import table
from semgraph.session import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed rules reject go."""
    return quality.drop_low_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; ``n_chars`` is the length of what is left."""
    cleaned = lines.drop_lines(docs)
    held = {c: F.char_length("text").cast(docs.schema[c].dataType) for c in docs.columns if c == "n_chars"}
    return cleaned.withColumns(held).select(*[F.col(f"`{c}`") for c in docs.columns])


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest ``doc_id`` stays."""
    return simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return benchmark.decontaminate(docs, table(spark, sf_dir, "benchmark"), "documents")


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``documents`` with ``ids`` (end id included), ``n_tokens`` and ``decoded``, the text of the ids."""
    return pieces.encode_documents(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("simhash_dedup", simhash_dedup),
          ("decontamination", decontamination), ("sentencepiece", sentencepiece)]

# The votes are weighed by an iteration; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result stored and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
