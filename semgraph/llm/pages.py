"""Main text of web pages: page structure, and differencing against the page with the nearest URL.

Pages are cut into blocks by their structure. The blocks of every page are compared with the page of the
same host whose URL path is nearest: the blocks of both are aligned by longest common subsequence, and the
shared ones are deleted. A check of the marks follows: paragraphs inside a marked article come back though
both pages have them, own blocks beside it go, and a mark that the neighbour shares in whole is a template's.
(Differencing alone would keep menus that two neighbours don't share and delete paragraphs that they do.)

Only hashes of blocks are paired. URLs are sorted over all tasks and numbered, so a page meets its
neighbours by number and a host with a third of all pages is spread like any others.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semgraph.llm.common import Queries, free_name, table
from semgraph.llm.urls import host_of, path_of
from semgraph.session import materialize

QUERIES = Queries()

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*>""", re.S)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
SPACE = re.compile("[ \t\n\r\f\v]+")

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noframes svg math object select".split())
ASIDE = frozenset("nav header footer aside form dialog menu button head".split())
ARTICLE = frozenset(("article", "main"))
#: Class, id and role words of parts that are no article, alone or before a hyphen or underscore.
OTHER = re.compile(r"(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notice|alert|popup|modal|overlay|menu|"
                   r"nav\w*|breadcrumbs?|sidebar|complementary|contentinfo|header|footer|masthead|search|form|login|"
                   r"newsletter|subscribe|share|social|related|recommended|comments?|commentlist|respond|disqus\w*|"
                   r"replies|pagination|pager|copyright|legal)(?:[-_].*)?", re.I)
#: Parts of which an article inside is no article of the page.
CLOSED = re.compile(r"(?:comments?|commentlist|respond|disqus\w*|replies|related|recommended|sidebar)(?:[-_].*)?", re.I)


def _words(attributes: str) -> list[str]:
    return [w for m in NAMES.finditer(attributes) for w in (m[1] or m[2] or m[3] or "").split()]


def _flat(text: str) -> str:
    """White space as single spaces, none at the ends."""
    if "&" in text:
        text = html.unescape(text)
    return SPACE.sub(" ", text).strip(" ")


def blocks_of(page: str) -> list[tuple[str, int]]:
    """Blocks outside of menus and the like, in page order, each with the number of the innermost marked
    article that it lies in, from 1, or 0."""
    blocks: list[tuple[str, int]] = []
    parts: list[str] = []
    aside, depth, closed, marks = "", 0, False, 0
    article: list[int] = []
    at, end = 0, len(page)

    def close() -> None:
        if parts:
            text = _flat("".join(parts))
            if text:
                blocks.append((text, article[-1] if article else 0))
            parts.clear()

    search = TAG.search
    while at < end:
        tag = search(page, at)
        if tag is None:
            if not aside:
                parts.append(page[at:])
            break
        if tag.start() > at and not aside:
            parts.append(page[at:tag.start()])
        at = tag.end()
        if tag[2] is None:
            continue
        name = tag[2].lower()
        if tag[1]:
            if aside:
                if name == aside:
                    depth -= 1
                    if not depth:
                        aside = ""
            else:
                if name not in INLINE:
                    close()
                if name in ARTICLE and article:
                    article.pop()
            continue
        if name in RAW:
            if not tag[3].endswith("/"):
                stop = re.compile(f"</{re.escape(name)}[^>]*>", re.I).search(page, at)
                at = stop.end() if stop else end
            if not aside and name not in INLINE:
                close()
            continue
        if name in ARTICLE and aside and not closed:
            aside, depth = "", 0
        if aside:
            depth += name == aside and not tag[3].endswith("/")
            continue
        if name in INLINE and not tag[3]:
            continue
        if name not in INLINE:
            close()
        if name in VOID:
            continue
        if name in ARTICLE:
            marks += 1
            article.append(marks)
            continue
        words = _words(tag[3]) if tag[3] and name not in ("html", "body") else []
        if (name in ASIDE and not (name == "header" and article)) or any(OTHER.fullmatch(w) for w in words):
            close()
            aside, depth = name, 1
            closed = name == "aside" or any(CLOSED.fullmatch(w) for w in words)
    close()
    return blocks


def outlines(page: Column) -> Column:
    """``array<long>``: hashes of the blocks."""

    @F.arrow_udf("array<bigint>")
    def outline(column: pa.Array) -> pa.Array:
        return pa.array([[xxhash.xxh64_intdigest(text) - 2**63 for text, _ in blocks_of(page or "")] for page in column.to_pylist()],
                        pa.list_(pa.int64()))
    return outline.asNondeterministic()(page)


#: Bits that ``shared`` holds at once; longer sequences are split.
TRACED = 1 << 24


def _rows(own: list[int], other: list[int]) -> Iterator[int]:
    """Rows of bits, one before ``own`` and one after each of its values: bit j is 0 where the length of a longest
    common subsequence grows at ``other[j]``."""
    where: dict[int, list[int]] = {}
    for j, value in enumerate(other):
        where.setdefault(value, []).append(j)
    often: dict[int, int] = {}

    def mask(value: int) -> int:
        if value in often:
            return often[value]
        places = where.get(value, ())
        if len(places) < 2:
            return 1 << places[0] if places else 0
        bits = bytearray(len(other) // 8 + 1)
        for j in places:
            bits[j >> 3] |= 1 << (j & 7)
        found = int.from_bytes(bits, "little")
        if len(places) > 64:
            often[value] = found
        return found

    row = full = (1 << len(other)) - 1
    yield row
    for value in own:
        both = row & mask(value)
        row = ((row + both) | (row - both)) & full
        yield row


def _lengths(own: list[int], other: list[int]) -> np.ndarray:
    """Lengths of longest common subsequences of ``own`` and the first 0, 1, 2 ... values of ``other``."""
    for row in _rows(own, other):
        last = row
    bits = np.unpackbits(np.frombuffer(last.to_bytes(len(other) // 8 + 1, "little"), np.uint8), bitorder="little")[:len(other)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _common(own: list[int], other: list[int]) -> list[int]:
    if not own or not other:
        return []
    if len(own) > 1 and len(own) * len(other) > TRACED:
        half = len(own) // 2
        at = int(np.argmax(_lengths(own[:half], other) + _lengths(own[:half - 1:-1], other[::-1])[::-1]))
        return _common(own[:half], other[:at]) + [half + i for i in _common(own[half:], other[at:])]
    rows = list(_rows(own, other))
    found, i, j = [], len(own), len(other)
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if i and not rows[i] >> (j - 1) & 1:
            continue
        found.append(i)
        j -= 1
    return found[::-1]


def shared(own: list[int], other: list[int]) -> list[int]:
    """Positions in ``own`` of a longest common subsequence of both. Memory grows with their lengths, not with the product."""
    both = set(own).intersection(other)
    places = [i for i, value in enumerate(own) if value in both]
    return [places[i] for i in _common([own[i] for i in places], [value for value in other if value in both])]


def checked(blocks: list[tuple[str, int]], deleted: list[int]) -> list[str]:
    """Blocks of the article: the check by marks that follows the differencing.

    Without marks these are the blocks that the neighbour does not share. Of the marked articles those stay whole that
    have a block of their own, or hold at least as much text as the page's own blocks do; others are a template's. If
    all are, the own blocks beside them are the text."""
    gone = frozenset(deleted)
    own = [text for i, (text, _) in enumerate(blocks) if i not in gone]
    size = sum(map(len, own))
    stays: dict[int, bool] = {}
    held: dict[int, int] = {}
    for i, (text, mark) in enumerate(blocks):
        held[mark] = held.get(mark, 0) + len(text)
        stays[mark] = stays.get(mark, False) or i not in gone
    return [text for text, mark in blocks if mark and (stays[mark] or held[mark] >= size)] or own


def numbered(sorted_rows: DataFrame) -> DataFrame:
    """Rows of a sorted frame with their place in it, from 0, as last column ``place``.

    The rows are written with their number inside the partition; only the sizes of the partitions
    go through the driver."""
    held = materialize(sorted_rows.withColumn("_id", F.monotonically_increasing_id()))
    sizes = held.groupBy(F.shiftright("_id", 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    starts = np.cumsum([0, *[r.n for r in sizes]])
    offsets = held.sparkSession.createDataFrame(
        [(r.part, int(s)) for r, s in zip(sizes, starts)], "part long, start long")
    return held.withColumn("part", F.shiftright("_id", 33)).join(F.broadcast(offsets), "part").withColumn(
        "place", F.col("start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id", "part", "start")


def page_key() -> Column:
    return F.struct(F.xxhash64("page_id", "url", "html").alias("a"), F.xxhash64(F.lit(1), "page_id", "url", "html").alias("b"))


def deletions(pages: DataFrame) -> DataFrame:
    """``key, deleted``: positions of the blocks that a page shares with its nearest neighbour.

    Pages of a host with the same blocks are one page, at their smallest path. Of the two beside it, one that
    shares all blocks, or all but a fifth of both, is a copy and only counts if the other is no better."""
    outlined = pages.select(page_key().alias("key"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                            outlines(F.col("html")).alias("all"))
    same = F.struct(F.xxhash64("host", "all").alias("a"), F.xxhash64(F.lit(1), "host", "all").alias("b"))
    # pages without a host are compared with none, so they need no group
    told = materialize(outlined.filter("size(all) > 0 AND host <> ''").distinct()
                       .withColumnRenamed("key", "page").withColumn("key", same))
    alone = told.groupBy("key").agg(F.first("host").alias("host"), F.min("path").alias("path"), F.first("all").alias("all"))
    placed = numbered(alone.orderBy("host", "path", "key"))
    near = placed.select("place", "host", "path", "all", "key")
    sides = [placed.join(near.select((F.col("place") + step).alias("place"), F.col("host").alias("nh"), F.col("path").alias("np"),
                                         F.col("all").alias("other"), F.col("key").alias("nk")), "place")
             .filter("host = nh AND key <> nk").withColumn("behind", F.lit(step)) for step in (1, -1)]

    @F.arrow_udf("struct<better: int, alike: int, deleted: array<int>>")
    def compare(own: pa.Array, other: pa.Array, path: pa.Array, near: pa.Array) -> pa.Array:
        better, alike, gone = [], [], []
        for a, b, p, q in zip(*(c.to_pylist() for c in (own, other, path, near))):
            places = shared(a, b)
            gone.append(places if len(places) < len(a) else [])
            better.append(0 if len(places) == len(a) else 1 if 5 * len(places) >= 4 * max(len(a), len(b)) else 2)
            alike.append(next((i for i, (x, y) in enumerate(zip(p, q)) if x != y), min(len(p), len(q))))
        return pa.StructArray.from_arrays([pa.array(better, pa.int32()), pa.array(alike, pa.int32()), pa.array(gone, pa.list_(pa.int32()))],
                                          names=["better", "alike", "deleted"])

    compared = sides[0].unionByName(sides[1]).select(
        "key", "behind", compare.asNondeterministic()("all", "other", "path", "np").alias("c"))
    # two rows a page at most: no copy wins, then the longer common path, then the page before
    best = compared.groupBy("key").agg(F.max_by("c.deleted", F.struct("c.better", "c.alike", "behind")).alias("deleted"))
    return told.select("page", "key").join(best.filter("size(deleted) > 0"), "key").select(F.col("page").alias("key"), "deleted")


def main_text(pages: DataFrame) -> DataFrame:
    """``pages`` with ``main_text`` appended: the blocks of the article, joined by one space.

    Blocks in menus, headers, footers, sidebars, forms, adverts, notices, comments, scripts and
    styles are left out, by tag and by class, id and role. Of the others those are the text that are not shared with
    the page of the same host whose path has the longest common start, of the two beside it in sorted order; a page
    that shares all of its blocks keeps them. If the page marks an article, ``checked`` follows: the blocks inside are
    the text, shared or not, unless the neighbour shares all of them and the page's own blocks hold more text. Character references are decoded, white space is one space. A null or empty page has an
    empty text; a page without URL is compared with none; repeated rows get the same text.
    """
    text, gone, key = (free_name(pages.columns, n) for n in ("main_text", "deleted", "page_key"))
    drops = materialize(deletions(pages.select("page_id", "url", "html"))).toDF(key, gone)
    met = pages.withColumn(f"{key}_own", page_key()).join(drops, F.col(f"{key}_own") == F.col(key), "left")

    @F.arrow_udf("string")
    def extract(column: pa.Array, deleted: pa.Array) -> pa.Array:
        out = []
        for page, gone in zip(column.to_pylist(), deleted.to_pylist()):
            out.append(" ".join(checked(blocks_of(page or ""), gone or [])))
        return pa.array(out, pa.string())

    return met.withColumn(text, extract.asNondeterministic()(F.col("html"), F.col(gone))).select(*[F.col(f"`{c}`") for c in pages.columns], text)


@QUERIES.add("op10_html_text")
def op10(spark, sf):
    found = main_text(table(spark, sf, "pages"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))
