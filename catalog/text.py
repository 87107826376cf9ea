"""Text preparation on documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Catalog, read
from semgraph.functions.text import (chunk_text, document_mentions, estimate_tokens,
                                     normalize_text)
from semgraph.functions.values import SPACE_PATTERN

CATALOG = Catalog()

FLAT = f"trim(regexp_replace(text, '{SPACE_PATTERN}', ' ', 'g'))"


@CATALOG.add("text_normalized", f"""
    SELECT doc_id, {FLAT} AS flat,
           CASE WHEN length({FLAT}) > 120 THEN substr({FLAT}, 1, 120) || '...' ELSE {FLAT} END AS short
    FROM documents""")
def normalized(spark, sf):
    docs = read(spark, sf, "documents")
    return docs.select("doc_id", normalize_text(F.col("text")).alias("flat"),
                       normalize_text(F.col("text"), 120).alias("short"))


@CATALOG.add("text_token_estimate", """
    SELECT role, COUNT(*) AS n_turns, CAST(SUM(length(text) // 4) AS BIGINT) AS n_tokens
    FROM conversations GROUP BY 1""")
def token_estimate(spark, sf):
    return read(spark, sf, "conversations").groupBy("role").agg(
        F.count("*").alias("n_turns"), F.sum(estimate_tokens(F.col("text"))).alias("n_tokens"))


@CATALOG.add("text_document_mentions", """
    SELECT 'MENTIONS' AS type, 'Document:' || doc_id AS source_id, 'Entity:extracted' AS target_id,
           text AS context FROM documents""")
def mentions(spark, sf):
    docs = read(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"), "source")
    return document_mentions(docs)


def _behind(mark: str, n: int) -> str:
    """SQL: the last place behind a mark, beyond the overlap and inside the chunk that starts at s."""
    window = f"substr(text, s + {202 - n}, {799 + n})"
    back = f"strpos(reverse({window}), reverse({mark}))"
    return f"CASE WHEN {back} > 0 THEN s + {201 - n} + length({window}) - {back} + 1 END"


_END = ("CASE WHEN s + 1000 >= length(text) THEN length(text) ELSE coalesce("
        + ", ".join(_behind(m, n) for m, n in (("'. '", 2), ("'! '", 2), ("'? '", 2), ("chr(10) || chr(10)", 2), ("chr(10)", 1)))
        + ", s + 1000) END")


@CATALOG.add("text_chunks", f"""
    WITH RECURSIVE starts AS (SELECT doc_id, text, 0 AS k, 0 AS s FROM documents WHERE text IS NOT NULL),
    cut AS (SELECT doc_id, text, k, s, {_END} AS e FROM starts
            UNION ALL SELECT doc_id, text, k, s, {_END} AS e
            FROM (SELECT doc_id, text, k + 1 AS k, e - 200 AS s FROM cut WHERE e < length(text))),
    pieces AS (SELECT doc_id, k, CASE WHEN length(text) <= 1000 THEN text
                      ELSE trim(substr(text, s + 1, e - s), ' ' || chr(10)) END AS piece, length(text) <= 1000 AS short FROM cut)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INT) AS chunk_index,
           CAST(count(*) OVER (PARTITION BY doc_id) AS INT) AS total_chunks, length(piece) AS n_chars, md5(piece) AS digest
    FROM pieces WHERE piece <> '' OR short""")
def chunks(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text")
    return chunk_text(docs, "text").select(
        "doc_id", "chunk_index", "total_chunks", F.length("text").alias("n_chars"),
        F.md5("text").alias("digest"))
