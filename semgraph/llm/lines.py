"""Line deduplication with DataFrame functions only.

Lines are exploded with their positions and reduced to a 128-bit hash of their normalised form; only
hashes, document ids and positions are shuffled to find the lines to drop. Texts move once, to meet the
positions of their dropped lines. A line that is common to many documents is combined in the map tasks
before it is counted, and the join back has one row per dropped hash on the other side, which adaptive
execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semgraph.llm.common import LOWER, SPACES, UPPER, Queries, ascii_lower, digest, free_name, table
from semgraph.session import materialize

QUERIES = Queries()


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``doc_id, body, drop``: positions (from 0) of the lines that ``drop_lines`` removes.

    ``body`` is a hash of the text, which tells apart rows that share a ``doc_id``.
    """
    lines = docs.filter("doc_id IS NOT NULL").select(
        "doc_id", F.xxhash64("text").alias("body"),
        F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keyed = lines.filter(F.char_length("line") >= min_chars).select(
        "doc_id", "body", "pos", line_key(F.col("line")).alias("key"))
    hashed = keyed.filter(F.char_length("key") >= min_chars).select(
        "doc_id", "body", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    # stored, so that the join reads plain shuffles, of which adaptive execution splits hot hashes
    common = materialize(hashed.select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2")
                         .agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
                         .filter(F.col("n") >= min_docs).select("h1", "h2", "keeper"))
    return (hashed.join(common, ["h1", "h2"]).filter("doc_id <> keeper")
            .groupBy("doc_id", "body").agg(F.collect_set("pos").alias("drop")))


def drop_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``; ``n_lines`` and ``n_dropped`` appended.

    Texts are split at line feeds. A line whose key (see ``line_key``) has at least ``min_chars``
    characters and is found in at least ``min_docs`` documents stays only in the document with the
    largest ``doc_id`` that holds it; there, all its occurrences stay. Lines keep their order.
    A null text counts as one empty line and becomes empty. Rows without ``doc_id`` are not counted
    and stay as they are. Rows that share a ``doc_id`` are one document in the counts and each keep
    their own lines. Columns named as the new ones stay; the new ones get underscores in front.
    """
    taken = docs.columns
    body, drop = free_name(taken, "body"), free_name(taken, "drop")
    n_lines, n_dropped = free_name(taken, "n_lines"), free_name(taken, "n_dropped")
    lines = free_name(taken, "lines")
    found = repeated_lines(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")),
                           min_chars, min_docs).toDF("doc_id", body, drop)
    texts = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn(body, F.xxhash64("text"))
    met = texts.join(found, ["doc_id", body], "left").withColumn(lines, F.split("text", "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(drop))
    kept = F.array_join(F.transform(stay, lambda i: F.get(F.col(lines), i)), "\n")
    return met.select(
        *[F.when(F.col(drop).isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text"
          else F.col(f"`{c}`") for c in taken],
        F.size(lines).cast("long").alias(n_lines),
        F.when(F.col(drop).isNull(), 0).otherwise(F.size(drop)).cast("long").alias(n_dropped))


_ENDS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@QUERIES.add("op1_line_dedup", f"""
    WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM split),
    keyed AS (SELECT *, translate(trim(line, {_ENDS}), '{UPPER}', '{LOWER}') AS key FROM lines),
    common AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
               GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
    marked AS (SELECT k.*, c.key IS NOT NULL AND doc_id <> keeper AS dropped
               FROM keyed k LEFT JOIN common c USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
    FROM marked GROUP BY doc_id""")
def op1(spark, sf):
    cleaned = drop_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", digest(F.col("text")).alias("kept_sha256"))
