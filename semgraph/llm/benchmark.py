"""Benchmark decontamination: a broadcast set of test n-grams, scanned over every document.

The windows of the benchmark are counted and dealt by hash into blocks of bounded size; each block is
sent to the executors once, as a broadcast variable, and all documents are scanned against it. With one
block there is no shuffle at all; with more, the hit lists are brought together by document, without texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from semgraph.llm.common import (LOWER, UPPER, Queries, ascii_lower, digest, free_name, table)
from semgraph.session import materialize

QUERIES = Queries()

WINDOW = 10
BLOCK_WINDOWS = 200_000

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The same words over UTF-8 bytes: everything else becomes a space, A-Z becomes a-z.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
                for b in range(256))
SPOKEN = re.compile(rb"[^ ]+")
FACTOR = 0x9E3779B97F4A7C15


def benchmark_windows(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """``item_id, window``: distinct runs of ``width`` words of each item as one string; an item of
    fewer words is one window, one without words has none."""
    words = F.regexp_extract_all(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(f"({WORD})"))
    spelt = items.select("item_id", words.alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (width - 1)))
    return (spelt.withColumn("at", F.explode(starts))
            .select("item_id", F.array_join(F.slice("words", F.col("at"), width), " ").alias("window"))
            .distinct())


def _hash(ids: np.ndarray, width: int) -> np.ndarray:
    """Rolling hash of every window; wraps at 64 bits."""
    wide, total = ids.astype(np.uint64), np.zeros(len(ids) - width + 1, np.uint64)
    for k in range(width):
        total = total * np.uint64(FACTOR) + wide[k:len(ids) - width + 1 + k]
    return total


def window_set(rows: list[Row]) -> tuple[dict, dict, dict]:
    """Of one block: numbers of its words, items by window, sorted window hashes by length."""
    words: dict[bytes, int] = {}
    items: dict[bytes, set[int | None]] = {}
    hashes: dict[int, list[int]] = {}
    for row in rows:
        spelt = [words.setdefault(w, len(words) + 1) for w in row.window.encode().split(b" ")]
        ids = np.array(spelt, np.int64)
        if ids.tobytes() not in items:
            hashes.setdefault(len(ids), []).append(int(_hash(ids, len(ids))[0]))
        items.setdefault(ids.tobytes(), set()).add(row.item_id)
    return words, items, {width: np.unique(np.array(h, np.uint64)) for width, h in hashes.items()}


def scan_text(windows: tuple[dict, dict, dict], text: str) -> tuple[int, np.ndarray, set[int | None]]:
    """Number of words, positions of hit words, items with a window in the text."""
    words, items, hashes = windows
    spelt = text.encode().translate(LETTERS).split()
    ids = np.array([words.get(w, 0) for w in spelt], np.int64)
    known = np.concatenate([[0], np.cumsum(ids > 0)])
    edges, found = np.zeros(len(ids) + 1, np.int64), set()
    for width, own in hashes.items():
        if len(ids) < width or known[-1] < width:
            continue
        whole = np.flatnonzero(known[width:] - known[:-width] == width)
        if not len(whole):
            continue
        hashed = _hash(ids, width)[whole]
        near = np.searchsorted(own, hashed)
        near[near == len(own)] = 0
        for start in whole[own[near] == hashed].tolist():
            held = items.get(ids[start:start + width].tobytes())
            if held:
                found |= held
                edges[start] += 1
                edges[start + width] -= 1
    return len(spelt), np.flatnonzero(np.cumsum(edges[:-1]) > 0), found


def _blocks(windows: DataFrame, block_windows: int) -> Iterator[tuple[int, list[Row]]]:
    """Number of blocks and rows of each. The count decides how many blocks there are; one is held at a time."""
    count = windows.count()
    parts = max(1, -(-count // block_windows))
    dealt = windows.withColumn("block", F.pmod(F.xxhash64("window", "item_id"), F.lit(parts)))
    for block in range(parts):
        yield parts, dealt.filter(F.col("block") == block).select("item_id", "window").collect()


def _scan(sent: Broadcast, text: Column) -> Column:
    @F.arrow_udf("struct<n_words: bigint, hits: array<int>, items: array<bigint>>")
    def scan(column: pa.Array) -> pa.Array:
        found = [scan_text(sent.value, t or "") for t in column.to_pylist()]
        return pa.StructArray.from_arrays([
            pa.array([n for n, _, _ in found], pa.int64()),
            pa.array([hits.tolist() for _, hits, _ in found], pa.list_(pa.int32())),
            pa.array([sorted(i for i in items if i is not None) for _, _, items in found],
                     pa.list_(pa.int64()))], names=["n_words", "hits", "items"])
    return scan.asNondeterministic()(text)


def contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW,
                  block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` with ``found``: ``struct<n_words, hits, items>``.

    A word of a document is hit if it lies inside an occurrence of a window of ``items(item_id,
    text)``: ``width`` consecutive words, or the whole item if it has fewer. ``hits`` holds the
    positions of hit words, ``items`` the ids with occurring windows. Null and empty texts have no
    words; an item without words has no window; an item without id marks words and is in no list.
    Hash matches count only if the words themselves are equal. Every block of at most about
    ``block_windows`` windows is broadcast and met by all documents; the hits of further blocks are stored
    block by block, without texts, and a block's broadcast ends before the next one begins.
    """
    spark, found = docs.sparkSession, free_name(docs.columns, "found")
    body = free_name([*docs.columns, found], "body")
    blocks = _blocks(benchmark_windows(items, width), block_windows)
    parts, rows = next(blocks)
    first = docs.withColumn(found, _scan(spark.sparkContext.broadcast(window_set(rows)), F.col("text")))
    if parts == 1:
        return first
    hits = []
    for _, rows in blocks:
        sent = spark.sparkContext.broadcast(window_set(rows))
        marked = docs.select("doc_id", F.xxhash64("text").alias(body), _scan(sent, F.col("text")).alias(found))
        hits.append(materialize(marked.filter(F.size(F.col(f"{found}.hits")) > 0).select(
            "doc_id", body, f"{found}.hits", f"{found}.items")))
        sent.destroy()
    union = hits[0]
    for more in hits[1:]:
        union = union.unionByName(more)
    # rows that share id and text have equal lists, so a set of lists is no longer than the blocks are many
    late = union.groupBy("doc_id", body).agg(
        F.flatten(F.collect_set("hits")).alias("late_hits"), F.flatten(F.collect_set("items")).alias("late_items")).select(
        F.col("doc_id").alias("late_id"), F.col(body).alias("late_body"), "late_hits", "late_items")
    none = F.array().cast("array<int>")
    met = first.withColumn(body, F.xxhash64("text")).join(
        late, F.col("doc_id").eqNullSafe(F.col("late_id")) & (F.col(body) == F.col("late_body")), "left")
    merged = F.struct(
        F.col(f"{found}.n_words").alias("n_words"),
        F.array_sort(F.array_union(f"{found}.hits", F.coalesce("late_hits", none))).alias("hits"),
        F.array_sort(F.array_union(f"{found}.items", F.coalesce("late_items", none.cast("array<bigint>")))).alias("items"))
    return met.select(*[F.col(f"`{c}`") for c in docs.columns], merged.alias(found))


def _without(text: str, hits: list[int]) -> str:
    """The text without its hit words and what stands between hit neighbours."""
    raw, hit = text.encode(), set(hits)
    spans = [m.span() for m in SPOKEN.finditer(raw.translate(LETTERS))]
    kept, at = [], 0
    for k, (start, end) in enumerate(spans):
        if k in hit:
            if k - 1 not in hit:
                kept.append(raw[at:start])
            at = end
    return b"".join([*kept, raw[at:]]).decode()


def decontaminate(docs: DataFrame, items: DataFrame, mode: str = "documents", width: int = WINDOW,
                  block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` without benchmark passages, in the columns of ``docs``.

    ``documents`` leaves out documents with a hit, ``spans`` takes the hit words and what stands
    between them out of the text. Other texts, null ones too, stay as they are.
    """
    marked = contamination(docs, items, width, block_windows)
    found = marked.columns[-1]
    hits = F.col(f"{found}.hits")
    if mode == "documents":
        return marked.filter(F.size(hits) == 0).drop(found)
    if mode != "spans":
        raise ValueError("mode is documents or spans")

    @F.arrow_udf("string")
    def cut(texts: pa.Array, hits: pa.Array) -> pa.Array:
        return pa.array([_without(t, h) if h else t for t, h in zip(texts.to_pylist(), hits.to_pylist())],
                        pa.string())
    return marked.withColumn("text", cut(F.col("text"), hits)).drop(found)


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')"


@QUERIES.add("op5_decontamination", f"""
    WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS width, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
           FROM b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS t(i) WHERE len(w) > 0),
    dw AS (SELECT doc_id, i, width, array_to_string(w[i:i + width - 1], ' ') AS win
           FROM (SELECT * FROM d, (SELECT DISTINCT width FROM bw)) AS x, unnest(range(1, len(w) - width + 2)) AS t(i)),
    hit AS (SELECT doc_id, i, width, item_id FROM dw JOIN bw USING (width, win)),
    words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + width)) AS t(p) GROUP BY doc_id),
    items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
              FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""")
def op5(spark, sf):
    marked = contamination(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark"))
    return marked.select(
        "doc_id", "found.n_words", F.size("found.hits").cast("long").alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        digest(F.array_join(F.array_sort(F.col("found.items").cast("array<string>")), ",")).alias("items_sha256"),
        (F.size("found.hits") > 0).alias("contaminated"))
