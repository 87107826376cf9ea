"""Text preparation."""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semgraph.functions.values import SPACE_PATTERN, strip

# Sentence ends in order of preference (fixed values).
SENTENCE_ENDS = (". ", "! ", "? ", "\n\n", "\n")


def normalize_text(col: Column, max_length: int | None = None) -> Column:
    """Collapse white space; beyond ``max_length`` characters truncate and append ``...``."""
    flat = strip(F.regexp_replace(col, SPACE_PATTERN, " "))
    if not max_length:
        return flat
    return F.when(F.length(flat) > max_length,
                  F.concat(F.substring(flat, 1, max_length), F.lit("..."))).otherwise(flat)


def estimate_tokens(col: Column) -> Column:
    """Rough token count: one per four characters."""
    return F.floor(F.length(col) / 4).cast("long")


def chunk_bounds(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Start and end of each chunk.

    The places behind all sentence ends are listed once, by kind. A chunk ends at the last place,
    of the first kind that has one, that lies beyond the overlap and inside the chunk's size, else
    at the full size; so every chunk takes the text further, and the one that reaches the end of the
    text is the last.
    """
    places = {mark: [m.end() for m in re.finditer(re.escape(mark), text)] for mark in SENTENCE_ENDS}
    bounds = [(0, len(text))] if len(text) <= size else []
    start = 0
    while not bounds or bounds[-1][1] < len(text):
        full = start + size
        inside = [known[bisect_right(known, full) - 1] for known in places.values()
                  if bisect_right(known, full) > bisect_right(known, start + overlap)]
        end = len(text) if full >= len(text) else inside[0] if inside else full
        bounds.append((start, end))
        start = end - overlap
    return bounds


def chunk_text(df: DataFrame, col: str, chunk_size: int = 1000, overlap: int = 200) -> DataFrame:
    """One row per overlapping chunk, snapped to a sentence end, with ``chunk_index`` and
    ``total_chunks``; white space at both ends of a chunk is cut and empty chunks are left out.

    Only the text column travels to Python, in Arrow batches.
    """
    if not 0 <= overlap < chunk_size:
        raise ValueError("the overlap must be smaller than a chunk")

    @F.arrow_udf("array<string>")
    def split(column: pa.Array) -> pa.Array:
        cut = [None if t is None else [t] if len(t) <= chunk_size else [
            piece for a, b in chunk_bounds(t, chunk_size, overlap) if (piece := t[a:b].strip())]
            for t in column.to_pylist()]
        return pa.array(cut, pa.list_(pa.string()))

    chunks = df.withColumn("_chunks", split.asNondeterministic()(F.col(col)))
    others = [c for c in df.columns if c != col]
    return chunks.select(
        *others, F.size("_chunks").alias("total_chunks"),
        F.posexplode("_chunks").alias("chunk_index", col),
    ).select(*others, "chunk_index", "total_chunks", col)


def document_mentions(df: DataFrame, content: str = "content", id_col: str = "id",
                      source_col: str = "source", context: int | None = None) -> DataFrame:
    """``MENTIONS`` relation from each document to ``Entity:extracted`` with its text as context, or
    its first ``context`` characters."""
    present = [F.when(F.col(c).cast("string") != "", F.col(c).cast("string"))
               for c in (id_col, source_col) if c in df.columns]
    doc = F.coalesce(*present, F.lit("unknown"))
    return df.filter(F.col(content).isNotNull()).select(
        F.lit("MENTIONS").alias("type"),
        F.when(doc.startswith("Document:"), doc)
        .otherwise(F.concat(F.lit("Document:"), doc)).alias("source_id"),
        F.lit("Entity:extracted").alias("target_id"),
        (F.col(content) if context is None else F.substring(content, 1, context)).alias("context"),
    )
