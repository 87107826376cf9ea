"""Prefix trie of conversations by union-find over sorted neighbours.

Conversations are lists of turn hashes. All of them are sorted over the cluster, so that the members of
every trie node are neighbours, and a node of depth ``d`` is a run of rows whose neighbours share at least
``d`` turns (their LCP). Each task takes one range of the sorted rows and joins neighbours by union-find in
descending order of their LCP: a merge at depth ``d`` creates the branching node of that depth, or widens it,
and the component that came from further down hangs below it with its run of one-child nodes in between.

Nodes that lie inside a range are finished there. Only prefixes of a range's first or last row can go on in
another range; the forest of a range is contracted to these two paths, and they are merged across the
boundaries by the hash of their prefix, so that the number of rows merged depends on the number of ranges and
not on the number of conversations. Sums over subtrees need no walk: a node's rows are a run, and what its
subtree saves is the sum of the words that each row shares with the row before it, less what all share above.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semgraph.llm.common import Queries, table
from semgraph.session import materialize

QUERIES = Queries()

BLOCK_IDS = 512
CLOSED, OPEN, ENDS, BORDER = range(4)
PARTS = pa.schema([
    ("kind", pa.int32()), ("range", pa.int32()), ("conv_id", pa.int64()), ("depth", pa.int64()),
    ("parent_conv_id", pa.int64()), ("key", pa.binary()), ("parent_key", pa.binary()),
    ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved", pa.int64()),
    ("words_above", pa.int64()), ("at_start", pa.bool_()), ("at_end", pa.bool_()), ("text", pa.string()),
    ("first_keys", pa.list_(pa.binary())), ("last_keys", pa.list_(pa.binary())),
    ("first_words", pa.list_(pa.int64()))])
PARTS_SQL = ("kind int, range int, conv_id bigint, depth bigint, parent_conv_id bigint, key binary, parent_key binary, "
             "n_convs bigint, n_children bigint, n_leaves bigint, saved bigint, words_above bigint, "
             "at_start boolean, at_end boolean, text string, first_keys array<binary>, last_keys array<binary>, "
             "first_words array<bigint>")


def turn_lists(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns`` of ``conversations(conv_id, turn, role, text)``, one row per ``conv_id``.

    A turn is ``struct<a, b, words>``: a 128-bit hash of role and text, and the number of words of the text.
    Turns go by ``turn``, null first; ties by their hash, a fixed order. Repeated rows are turns of their own.
    Null roles and texts count as empty. Rows without ``conv_id`` belong to no conversation and are left out.
    Texts are not shuffled; a conversation takes 24 bytes a turn in one row.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.filter("conv_id IS NOT NULL").select(
        "conv_id", F.struct(F.col("turn").alias("turn"), F.xxhash64(role, text).alias("a"),
                            F.xxhash64(F.lit(1), role, text).alias("b"),
                            F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words")).alias("t"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")).select(
        "conv_id", F.transform("turns", lambda t: F.struct(t.a.alias("a"), t.b.alias("b"), t.words.alias("words"))).alias("turns"))


def shared_openings(lists: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """``lists`` in which every conversation opens like the first of its family.

    The first ``h`` turns of conversation ``c`` are those of conversation ``c - c % family`` (fewer if it has
    fewer, none if there is no such conversation), its own turns from the ``h + 1``-th on follow;
    ``h`` is the unsigned CRC-32 of the decimal ``c``, modulo ``most``.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    heads = lists.filter(F.col("conv_id") % family == 0).select(
        F.col("conv_id").alias("head_id"), F.slice("turns", 1, most - 1).alias("head"))
    led = lists.withColumn("head_id", F.col("conv_id") - F.col("conv_id") % family).join(heads, "head_id", "left")
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return led.select("conv_id", F.concat(F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), h), own).alias("turns"))


class Forest:
    """Trie of sorted rows. A node ``t`` has ``depth``, the rows ``low`` to ``high``, the ``least`` id,
    ``children``, the number of rows that ``end`` in it, and the node ``up`` (-1: none)."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, lcp: np.ndarray) -> None:
        n = len(ids)
        self.depth, self.low, self.high = sizes.tolist(), list(range(n)), list(range(n))
        self.least, self.children, self.ends, self.up = ids.tolist(), [0] * n, [1] * n, [-1] * n
        self.same = list(range(n))
        of_row, chief = list(range(n)), list(range(n))

        def find(x: int) -> int:
            while chief[x] != x:
                chief[x] = chief[chief[x]]
                x = chief[x]
            return x

        members = [1] * n
        for i in (np.argsort(-lcp[1:], kind="stable") + 1).tolist():
            at, x, y = int(lcp[i]), find(i - 1), find(i)
            node = self._meet(of_row[x], of_row[y], at)
            if members[x] < members[y]:
                x, y = y, x
            chief[y], members[x], of_row[x] = x, members[x] + members[y], node
        top = of_row[find(0)]
        if self.depth[top] > 0:
            self._above(top, 0)

    def _above(self, node: int, at: int) -> int:
        self.up[node] = made = len(self.depth)
        for values, value in ((self.depth, at), (self.low, self.low[node]), (self.high, self.high[node]),
                              (self.least, self.least[node]), (self.children, 1), (self.ends, 0), (self.up, -1),
                              (self.same, made)):
            values.append(value)
        return made

    def _meet(self, left: int, right: int, at: int) -> int:
        node = left if self.depth[left] == at else self._above(left, at)
        if self.depth[right] > at:
            self.up[right] = node
            self.children[node] += 1
        else:
            self.same[right] = node
            self.children[node] += self.children[right]
            self.ends[node] += self.ends[right]
        self.high[node] = self.high[right]
        self.least[node] = min(self.least[node], self.least[right])
        return node

    def table(self) -> dict[str, np.ndarray]:
        """The nodes as arrays; ``up`` is a place in them."""
        same = np.array(self.same)
        while (following := same[same] != same).any():
            same[following] = same[same[following]]
        kept = np.flatnonzero(same == np.arange(len(same)))
        place = np.full(len(same) + 1, -1)
        place[kept] = np.arange(len(kept))
        ups = np.array(self.up)[kept]
        out = {name: np.array(getattr(self, name), np.int64)[kept]
               for name in ("depth", "low", "high", "least", "children", "ends")}
        return out | {"up": place[np.where(ups < 0, -1, same[ups])]}


def neighbour_lcp(starts: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of equal leading turns of each row and the row before; 0 for the first."""
    within = np.arange(len(a)) - np.repeat(starts, sizes)
    before, long = np.roll(starts, 1), np.roll(sizes, 1)
    long[:1] = 0
    there = within < np.repeat(long, sizes)
    other = np.where(there, np.repeat(before, sizes) + within, 0)
    unlike = np.where(there & (a == a[other]) & (b == b[other]), np.iinfo(np.int64).max, within) if len(a) else within
    out = np.zeros(len(sizes), np.int64)
    some = sizes > 0
    if some.any():
        out[some] = np.minimum(np.minimum.reduceat(unlike, starts[some]), sizes[some])
    return out


def prefix_keys(a: np.ndarray, b: np.ndarray) -> list[bytes]:
    """Hash of each prefix of a row of turns, the empty one first."""
    keys = [b""]
    for turn in np.stack([a, b], 1):
        keys.append(hashlib.blake2b(keys[-1] + turn.tobytes(), digest_size=16).digest())
    return keys


def range_trie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Finished nodes, open paths and blocks of ids of one range of sorted rows ``conv_id, turns``."""
    held = [batch for batch in batches if batch.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held).combine_chunks()
    ids = rows.column("conv_id").chunk(0).to_numpy()
    turns = rows.column("turns").chunk(0)
    a, b, words = (turns.flatten().field(name).to_numpy() for name in ("a", "b", "words"))
    sizes = np.diff(turns.offsets.to_numpy()).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(np.int64)
    n, lcp = len(ids), neighbour_lcp(starts, sizes, a, b)
    total = np.concatenate([[0], np.cumsum(words)]).astype(np.int64)
    shared = np.cumsum(total[starts + lcp] - total[starts])
    leaf = np.concatenate([[0], np.cumsum(np.append(lcp[1:] < sizes[:-1], False))])
    first_keys, last_keys = (prefix_keys(a[s:s + k], b[s:s + k]) for s, k in ((starts[0], sizes[0]), (starts[-1], sizes[-1])))
    here = TaskContext.get().partitionId()
    yield _rows(BORDER, here, 1, first_keys=[first_keys], last_keys=[last_keys],
                first_words=[(total[starts[0]:starts[0] + sizes[0] + 1] - total[starts[0]]).tolist()])

    nodes = Forest(ids, sizes, lcp).table()
    open_ = (nodes["low"] == 0) | (nodes["high"] == n - 1)
    base = np.where(nodes["up"] < 0, 0, nodes["depth"][nodes["up"]] + 1)

    def key_of(node: int, depth: int) -> bytes:
        return (first_keys if nodes["low"][node] == 0 else last_keys)[depth]

    for chosen, kind in ((~open_, CLOSED), (open_, OPEN)):
        for some in np.array_split(np.flatnonzero(chosen), max(1, int(chosen.sum()) // 20_000)):
            tall = nodes["depth"][some] - base[some] + 1
            at = np.repeat(some, tall)
            depth = base[at] + np.arange(len(at)) - np.repeat(np.cumsum(tall) - tall, tall)
            top, low, high = depth == nodes["depth"][at], nodes["low"][at], nodes["high"][at]
            up, count = nodes["up"][at], nodes["high"][at] - nodes["low"][at] + 1
            above = total[starts[low] + np.maximum(depth - 1, 0)] - total[starts[low]]
            saved = shared[high] - shared[low]
            lowest = depth == base[at]
            columns = {"depth": depth, "conv_id": nodes["least"][at], "n_convs": count, "words_above": above,
                       "n_children": np.where(top, nodes["children"][at], 1), "n_leaves": leaf[high + 1] - leaf[low]}
            if kind == OPEN:
                ends = nodes["ends"][at]
                columns |= {"saved": saved, "at_start": low == 0, "at_end": high == n - 1,
                            "key": [key_of(t, d) for t, d in zip(at.tolist(), depth.tolist())],
                            "parent_key": [key_of(t, d - 1) if d else None for t, d in zip(at.tolist(), depth.tolist())]}
                yield _rows(OPEN, here, len(at), **columns)
                for t, d, full in zip(at.tolist(), depth.tolist(), (top & (ends > 0)).tolist()):
                    if full:
                        yield from _id_blocks(here, key_of(t, d), ids[nodes["low"][t]:nodes["low"][t] + nodes["ends"][t]])
                continue
            known = ~lowest | ~open_[up]
            columns |= {"saved": saved - (count - 1) * above,
                        "parent_conv_id": pa.array(np.where(lowest, nodes["least"][up], nodes["least"][at]), mask=~known),
                        "parent_key": [None if k else key_of(u, d - 1)
                                       for k, u, d in zip(known.tolist(), up.tolist(), depth.tolist())],
                        "text": [_hash_ids(ids[i:i + k]) if full else NO_IDS for i, k, full in
                                 zip(low.tolist(), nodes["ends"][at].tolist(), top.tolist())]}
            yield _rows(CLOSED, here, len(at), **columns)


def _hash_ids(ids: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest()


NO_IDS = hashlib.sha256(b"").hexdigest()


def _id_blocks(here: int, key: bytes, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    starts = range(0, len(ids), BLOCK_IDS)
    yield _rows(ENDS, here, len(starts), key=[key] * len(starts), conv_id=[int(ids[i]) for i in starts],
                text=[",".join(map(str, ids[i:i + BLOCK_IDS].tolist())) for i in starts])


def _rows(kind: int, here: int, count: int, **columns) -> pa.RecordBatch:
    columns |= {"kind": [kind] * count, "range": [here] * count}
    return pa.record_batch([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(count, f.type)
                            for f in PARTS], schema=PARTS)


def hash_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined blocks of each key; blocks of a key follow each other."""
    schema = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])
    key, running = None, None
    for batch in batches:
        done: list[tuple[bytes, str]] = []
        for of, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
            if of != key:
                done += [(key, running.hexdigest())] if running else []
                key, running = of, hashlib.sha256(text.encode())
            else:
                running.update(b"," + text.encode())
        yield pa.record_batch([[k for k, _ in done], [h for _, h in done]], schema=schema)
    if running:
        yield pa.record_batch([[key], [running.hexdigest()]], schema=schema)


def prefix_trie(lists: DataFrame) -> DataFrame:
    """One row per distinct prefix of the lists ``conv_id, turns`` (see ``turn_lists``; ids are distinct).

    ``conv_id`` smallest member, ``depth``, ``parent_conv_id`` (null at the root), ``n_convs``, ``n_children``,
    ``n_leaves`` (childless nodes of the subtree, itself included), ``saved_tokens`` (over the subtree, the
    words of a node's last turn times its members less one), ``ends_sha256`` (of the ascending, comma-joined
    ids of the members that end there). Lists without turns belong to the root alone; equal lists share all
    their nodes; no lists, no nodes. Columns beside the two are not used.

    A list that a third of all conversations share is split over many ranges, as ids are part of the sort
    order. The ids that end in a node that spans ranges are joined to blocks in these, and one task reads
    the blocks of a node in order, without holding them: a digest cannot be split.
    """
    known = materialize(lists.select("conv_id", "turns"))
    ordered = known.repartitionByRange("turns", "conv_id").sortWithinPartitions("turns", "conv_id")
    parts = materialize(ordered.mapInArrow(range_trie, PARTS_SQL))

    in_order = Window.orderBy("range")  # one row per range
    shared = F.coalesce(F.size(F.array_intersect(F.lag("last_keys").over(in_order), "first_keys")) - 1, F.lit(-1))
    borders = (parts.filter(F.col("kind") == BORDER)
               .select("range", "first_words", shared.alias("before"), F.size("last_keys").alias("last_size"),
                       F.size("first_keys").alias("first_size"))
               .select("range", "before", F.coalesce(F.lead("before").over(in_order), F.lit(-1)).alias("after"),
                       (F.col("first_size") - 1).alias("first_size"), (F.col("last_size") - 1).alias("last_size"),
                       F.when(F.col("before") >= 0, F.expr("element_at(first_words, before + 1)")).alias("shared_words")))
    goes_on = F.col("at_start") & (F.col("before") >= F.col("depth"))
    longer = F.col("first_size") > F.col("depth")
    merged = (parts.filter(F.col("kind") == OPEN).drop("first_keys", "last_keys", "first_words", "text")
              .join(borders, "range")
              .withColumns({
                  "saved": F.col("saved") + F.when(goes_on, F.col("shared_words")).otherwise(0),
                  "n_children": F.col("n_children") - F.when(
                      goes_on & longer & (F.col("before") > F.col("depth")), 1).otherwise(0),
                  "n_leaves": F.col("n_leaves") + F.when(
                      F.col("at_end") & (F.col("after") < F.col("last_size")), 1).otherwise(0)})
              .groupBy("key", "parent_key", "depth", "words_above")
              .agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")])
              .withColumn("saved", F.col("saved") - (F.col("n_convs") - 1) * F.col("words_above")))
    blocks = parts.filter(F.col("kind") == ENDS).select("key", "conv_id", "text")
    digests = (blocks.repartition("key").sortWithinPartitions("key", "conv_id").select("key", "text")
               .mapInArrow(hash_blocks, "key binary, ends_sha256 string"))
    opened = materialize(merged.join(digests, "key", "left")
                         .withColumn("text", F.coalesce("ends_sha256", F.lit(NO_IDS))).drop("ends_sha256"))
    parents = opened.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("of_parent"))
    values = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved", "text"]
    closed = parts.filter(F.col("kind") == CLOSED).select(*values, "parent_conv_id", "parent_key")
    inner = closed.filter("parent_key IS NULL").drop("parent_key")
    outer = (closed.filter("parent_key IS NOT NULL").select(*values, "parent_key")
             .unionByName(opened.select(*values, "parent_key")).join(parents, "parent_key", "left")
             .select(*values, F.col("of_parent").alias("parent_conv_id")))
    return inner.unionByName(outer).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.col("text").alias("ends_sha256"))


OP12_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)
              ORDER BY i) AS crc_of FROM range(256) r(i)),
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint)),
                                  lambda x, y: xor(x >> 8, crc_of[(xor(x, y) & 255) + 1])), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turns), bits),
rebuilt AS (
  SELECT c.conv_id, t.role, t.text, t.pos AS pos FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, t.role, t.text, t.pos + 1000000 FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h),
placed AS (
  SELECT conv_id, text, sha256(length(role) || ':' || role || text) AS turn,
         row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth FROM rebuilt),
prefixes AS (
  SELECT conv_id, depth, sha256(string_agg(turn, '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth)) AS prefix,
         len(list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'), lambda w: w <> '')) AS words
  FROM placed
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
sized AS (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS whole FROM prefixes),
nodes AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words, max(whole) > depth AS has_child,
         sha256(coalesce(string_agg(conv_id::varchar, ',' ORDER BY conv_id) FILTER (WHERE whole = depth), '')) AS ends_sha256
  FROM sized GROUP BY prefix, depth),
paths AS (
  SELECT n.prefix, n.depth, p.prefix AS over_prefix, p.depth AS over_depth, n.n_convs, n.words, n.has_child
  FROM nodes n JOIN prefixes p ON p.conv_id = n.conv_id AND p.depth <= n.depth),
sums AS (
  SELECT over_prefix AS prefix, over_depth AS depth, sum((n_convs - 1) * words) AS saved_tokens,
         count(*) FILTER (WHERE NOT has_child) AS n_leaves, count(*) FILTER (WHERE depth = over_depth + 1) AS n_children
  FROM paths GROUP BY over_prefix, over_depth)
SELECT n.conv_id::bigint AS conv_id, n.depth::bigint AS depth, o.conv_id::bigint AS parent_conv_id, n.n_convs::bigint AS n_convs,
       s.n_children::bigint AS n_children, s.n_leaves::bigint AS n_leaves, s.saved_tokens::bigint AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.prefix = n.prefix AND s.depth = n.depth
LEFT JOIN paths p ON p.prefix = n.prefix AND p.depth = n.depth AND p.over_depth = n.depth - 1
LEFT JOIN nodes o ON o.prefix = p.over_prefix AND o.depth = p.over_depth
"""


@QUERIES.add("op12_prefix_trie", OP12_SQL)
def op12(spark, sf):
    return prefix_trie(shared_openings(materialize(turn_lists(table(spark, sf, "conversations")))))
