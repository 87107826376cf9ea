"""SimHash near-duplicates with BK-trees.

Distinct fingerprints are dealt into shards by pairs of 16-bit blocks: two fingerprints that differ in
at most two of their four blocks' bits agree in two whole blocks, so all links are found inside shards.
Each shard is a BK-tree whose children are keyed by their Hamming distance to the parent; a search
follows only the edges within the radius. Shards reach their tasks by the shuffle: broadcasting them
would take the fingerprints of all documents through the driver. A shard keeps a spanning forest of its
links, not all pairs. A large shard is dealt again by the blocks of the bits that it leaves open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semgraph.llm.common import Queries, free_name, table, texts_of
from semgraph.operators.components import component_labels
from semgraph.session import materialize

QUERIES = Queries()

SEED = 42
RADIUS = 2
TREE_NODES = 2048
BANDS, BAND_ROWS = 16, 5
STEP = 1.02
MULTIPLIERS = np.random.default_rng(7).integers(1, 2**64, BANDS * BAND_ROWS, np.uint64, endpoint=False) | np.uint64(1)


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words, repeats included, as big-endian 64-bit numbers; of the
    whole sequence if it has fewer words. Only A-Z are lower-cased, words end at ASCII white space."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, ">u8")
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    count, hash_of = max(1, len(words) - width + 1), xxhash.xxh64_digest
    last = ends[width - 1:] if len(words) >= width else ends[-1:]
    return np.frombuffer(b"".join([hash_of(joined[i:j], SEED) for i, j in
                                   zip(starts[:count].tolist(), last.tolist())]), ">u8")


def fingerprint(hashes: np.ndarray) -> int:
    """64 bits, each set if it is set in over half of the hashes; signed, 0 without hashes."""
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255 * 64):
        planes = np.unpackbits(hashes[at:at + 255 * 64].view(np.uint8).reshape(-1, 8), axis=1)
        # eight one-byte counters to a word; no counter passes 255 rows
        parts = np.add.reduceat(planes.view(np.uint64), np.arange(0, len(planes), 255), axis=0)
        bits += parts.view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes)).view(">i8")[0])


def fingerprints(text: Column, width: int = 3) -> Column:
    """SimHash of the text's ``width``-word shingles, ``long``; a text without words has 0."""

    @F.arrow_udf("bigint")
    def print_of(column: pa.Array) -> pa.Array:
        return pa.array([fingerprint(shingle_hashes(t or "", width)) for t in texts_of(column)], pa.int64())
    return print_of.asNondeterministic()(text)


def tree_links(values: list[int], radius: int, every: bool = False) -> Iterator[tuple[int, int]]:
    """Spanning links of distinct fingerprints within the radius, or all pairs, by a BK-tree."""
    children: dict[int, dict[int, int]] = {values[0]: {}}
    root_of = {v: v for v in values}

    def root(v: int) -> int:
        while root_of[v] != v:
            root_of[v] = root_of[root_of[v]]
            v = root_of[v]
        return v

    for value in values[1:]:
        search = [values[0]]
        while search:
            node = search.pop()
            apart = ((value ^ node) & 0xFFFFFFFFFFFFFFFF).bit_count()
            if apart <= radius and (every or root(value) != root(node)):
                root_of[root(value)] = root(node)
                yield value, node
            below = children[node]
            search += [below[d] for d in range(apart - radius, apart + radius + 1) if d in below]
        node = values[0]
        while True:
            apart = ((value ^ node) & 0xFFFFFFFFFFFFFFFF).bit_count()
            following = children[node].get(apart)
            if following is None:
                children[node][apart] = value
                children[value] = {}
                break
            node = following


def _finer(mask: int) -> list[int]:
    """``mask`` and two of four equal parts of the bits outside it: two numbers that agree under ``mask`` and
    differ in at most two bits agree under one of the results."""
    free = [b for b in range(64) if not mask >> b & 1]
    size = len(free) // 4
    parts = [sum(1 << b for b in free[i * size:(i + 1) * size]) for i in range(4)]
    return [mask | parts[i] | parts[j] for i in range(4) for j in range(i)]


def _signed(number: int) -> int:
    return number - 2**64 if number >> 63 else number


def fingerprint_links(prints: DataFrame, radius: int = RADIUS, tree_nodes: int = TREE_NODES,
                      every: bool = False) -> DataFrame:
    """``u, v``: links among distinct ``prints(fp)`` that join all fingerprints within ``radius``
    (at most 2) of each other, directly or through others; with ``every`` all such pairs, some of them
    repeatedly. A fingerprint has at most 2080 others within two bits, so pairs grow with the rows.

    All go by BK-trees. A shard holds the fingerprints that agree in two of four blocks; one of more than
    ``tree_nodes`` is dealt again by the blocks of its remaining 32 bits, and those by their remaining 16, so
    that the last have at most 256 members."""
    if not 0 <= radius <= 2:
        raise ValueError("shards are exact up to a radius of two")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[int] = []
        shard = None
        for batch in batches:
            found: list[tuple[int, int]] = []
            for mask, key, value in zip(*(batch.column(c).to_pylist() for c in ("mask", "shard", "fp"))):
                if (mask, key) != shard and held:
                    found += tree_links(held, radius, every)
                    held = []
                shard = mask, key
                held.append(value)
            yield _pairs(found)
        yield _pairs(list(tree_links(held, radius, every)) if held else [])

    def dealt(rows: DataFrame, masks: Column) -> DataFrame:
        keyed = (rows.select("fp", F.explode(masks).alias("mask")).distinct()
                 .withColumn("shard", F.col("fp").bitwiseAND(F.col("mask"))))
        sizes = keyed.groupBy("mask", "shard").agg(F.count("*").alias("n")).filter("n > 1")
        return materialize(keyed.join(sizes, ["mask", "shard"]))

    rows, trees, masks = prints, [], [0]
    for depth in range(3):
        finer = {mask: _finer(mask) for mask in masks}
        of = F.array(*[F.lit(_signed(m)) for m in finer[0]]) if depth == 0 else F.element_at(F.create_map(*[
            c for mask, more in finer.items() for c in (F.lit(_signed(mask)), F.array(*[F.lit(_signed(m)) for m in more]))]),
            F.col("mask"))
        masks = sorted({m for more in finer.values() for m in more})
        sharded = dealt(rows, of)
        small = sharded.filter(F.col("n") <= tree_nodes) if depth < 2 else sharded
        trees.append(small.select("mask", "shard", "fp").repartition("mask", "shard")
                     .sortWithinPartitions("mask", "shard", "fp").mapInArrow(links, "u bigint, v bigint"))
        rows = sharded.filter(F.col("n") > tree_nodes).select("fp", "mask")
        if depth == 2 or rows.isEmpty():
            break
    found = trees[0]
    for more in trees[1:]:
        found = found.unionByName(more)
    return found


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([u for u, _ in found], pa.int64()),
                            pa.array([v for _, v in found], pa.int64())], names=["u", "v"])


def simhash_groups(docs: DataFrame, width: int = 3, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fp, component_id`` of every row of ``docs(doc_id, text)``.

    Documents whose fingerprints differ in at most ``radius`` bits are linked; ``component_id`` is
    the smallest ``doc_id`` reachable over links. Null and empty texts have fingerprint 0 and are
    linked like any other. A null ``doc_id`` takes part but is never the smallest; a group of such
    rows alone has a null ``component_id``. Repeated rows stay.
    """
    prints = materialize(docs.select("doc_id", fingerprints(F.col("text"), width).alias("fp")))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    labels = component_labels(fingerprint_links(least.select("fp"), radius))
    linked = least.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp"))
    smallest = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = linked.select("fp", "component").join(smallest, "component").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


# Near-duplicates by similarity ----------------------------------------------------------------


def distinct_shingles(text: str | None, width: int) -> np.ndarray:
    """Different shingle hashes of a text, ascending."""
    return np.unique(shingle_hashes(text or "", width).astype(np.uint64))


def sketches(text: Column, width: int) -> Column:
    """``struct<fp, a, b, bands>``: the SimHash, a 128-bit hash of the set of shingles, and ``BANDS`` hashes each of
    the least values that ``BAND_ROWS`` multiplications give to the shingles."""

    @F.arrow_udf("struct<fp: bigint, a: bigint, b: bigint, bands: array<bigint>>")
    def sketch(column: pa.Array) -> pa.Array:
        prints, sets, bands = [], [], []
        for text in texts_of(column):
            hashes = shingle_hashes(text or "", width)
            prints.append(fingerprint(hashes))
            own = np.unique(hashes.astype(np.uint64))
            sets.append(xxhash.xxh3_128_digest(own.tobytes()))
            least = (np.stack([(own * m).min() for m in MULTIPLIERS]) if len(own)
                     else np.zeros(len(MULTIPLIERS), np.uint64)).reshape(BANDS, BAND_ROWS)
            bands.append([xxhash.xxh64_intdigest(row.tobytes(), n) - 2**63 for n, row in enumerate(least)])
        halves = np.frombuffer(b"".join(sets), np.int64).reshape(-1, 2)
        return pa.StructArray.from_arrays([pa.array(prints, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]),
                                           pa.array(bands, pa.list_(pa.int64()))], names=["fp", "a", "b", "bands"])
    return sketch.asNondeterministic()(text)


def shingle_sets(text: Column, width: int) -> Column:
    """Different shingle hashes of each text, ``array<long>``."""

    @F.arrow_udf("array<bigint>")
    def sets(column: pa.Array) -> pa.Array:
        return pa.array([distinct_shingles(t, width).view(np.int64) for t in texts_of(column)], pa.list_(pa.int64()))
    return sets.asNondeterministic()(text)


def close_sets(sets: DataFrame, similarity: float) -> DataFrame:
    """``u, v``: candidates among ``sets(node, component, shingles)``, all pairs of different components whose
    Jaccard similarity reaches ``similarity`` among them.

    Shingles are ordered by the number of sets that have them, rare ones first. Two sets of ``n`` and ``m``
    shingles that are close have ``s / (1 + s) * (n + m)`` of them in common (``s`` the similarity), so
    the first common one stands early in both: no more than the others may come before it. A set is therefore
    filed under its early shingles, and there by its own size and each size that a partner may have, in steps
    of ``STEP``; the later the shingle, the fewer sizes. What a bucket shares widely comes late in the order
    and is no key for sets that differ in more than the similarity allows. Each key then tightens its
    bound to the least size that is really there, and its largest component is only met by the others.
    """
    s = similarity

    def size_class(size: Column) -> Column:
        return F.floor(F.log(size) / float(np.log(STEP))).cast("int")

    def common(n: Column, m: Column) -> Column:
        return F.ceil((n + m) * (s / (1 + s)) - 1e-9)

    n, least = F.col("n"), F.ceil(F.col("n") * s - 1e-9)
    spread = sets.select("node", "component", F.explode("shingles").alias("shingle"))
    many = spread.groupBy("shingle").agg(F.count("*").alias("sets"))
    ordered = (spread.join(many, "shingle").groupBy("node", "component")
               .agg(F.sort_array(F.collect_list(F.struct("sets", "shingle"))).alias("shingles"))
               .withColumn("n", F.size("shingles")))
    early = (ordered.select("node", "component", "n", F.posexplode(F.slice("shingles", F.lit(1), (n - least + 1).cast("int"))).alias("at", "x"))
             .filter("x.sets > 1").withColumn("most", F.least(F.floor((n - F.col("at")) * ((1 + s) / s) + 1e-9) - n, F.floor(n / s + 1e-9)))
             .filter(F.col("most") >= least))
    own = size_class(n)
    filed = materialize(early.select(
        F.col("x.shingle").alias("shingle"), "node", "component", "n", "at", own.alias("own"),
        F.explode(F.sequence(size_class(least), size_class(F.col("most")))).alias("other"))
        .select("shingle", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
                "node", "component", "n", "at", "own"))
    key = ["shingle", "low", "high"]
    there = (filed.groupBy(*key).agg(
        F.min(F.when(F.col("own") == F.col("low"), n)).alias("low_n"), F.min(F.when(F.col("own") == F.col("high"), n)).alias("high_n"),
        F.min("component").alias("one"), F.max("component").alias("two"))
        .filter("one < two AND low_n IS NOT NULL AND high_n IS NOT NULL").drop("one", "two"))
    partner = F.when(F.col("own") == F.col("low"), F.col("high_n")).otherwise(F.col("low_n"))
    tight = materialize(filed.join(there, key).filter(n - F.col("at") >= common(n, F.greatest(partner, least))).select(filed.columns))
    largest = (tight.groupBy(*key, "component").agg(F.count("*").alias("rows")).groupBy(*key)
               .agg(F.max(F.struct("rows", "component")).alias("most"), F.count("*").alias("components"))
               .filter("components > 1").select(*key, F.col("most.component").alias("largest")))
    few = tight.join(largest, key).filter("component <> largest").drop("largest").select(
        *key, *[F.col(c).alias(f"few_{c}") for c in ("node", "component", "n", "at", "own")])
    m, left = F.col("few_n"), F.least(n - F.col("at"), F.col("few_n") - F.col("few_at"))
    met = few.join(tight, key).filter(
        (F.col("component") != F.col("few_component")) & ((F.col("low") == F.col("high")) | (F.col("own") != F.col("few_own")))
        & (left >= common(n, m)) & (F.least(n, m) >= F.greatest(n, m) * s - 1e-9))
    return met.select(F.greatest("node", "few_node").alias("u"), F.least("node", "few_node").alias("v")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``doc_id, copy_of`` of the documents that have a near copy with a smaller ``doc_id``.

    Texts with the same set of shingles become one first. Candidates are all SimHash pairs within the radius,
    equal ones too, and, since at a similarity of 0.8 SimHashes differ in about nine bits, all texts that share a band
    of least shingle values. Every bucket first compares its texts with the one that shares buckets with most
    others, which stands in the middle of its group. Texts of buckets that hold several groups after that are
    compared by ``close_sets``, which finds every close pair among them without comparing a bucket pair by pair. Pairs count if the exact share of common ``width``-word
    shingles, each counted once, is at least ``similarity``. ``copy_of`` is the smallest ``doc_id`` of the linked
    group. Texts without words, null ones too, are copies of each other. Rows without ``doc_id`` have no copies;
    rows that share one are one document, linked through any of their texts. Columns beside ``doc_id`` and
    ``text`` are not used.
    """
    rows = docs.filter("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("own"), sketches(F.col("text"), width).alias("s"))
    sketched = materialize(rows.select("doc_id", "own", "s.fp", "s.a", "s.b", "s.bands"))
    # stored with its numbers, which stay the same from then on
    texts = materialize(sketched.groupBy("a", "b").agg(
        F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id()))
    held_by = materialize(sketched.select("doc_id", "own", "a", "b").join(texts.select("a", "b", "node", "least"), ["a", "b"])
                          .groupBy("doc_id", "node", "least").agg(F.min("own").alias("own")))
    close = fingerprint_links(texts.select("fp").distinct(), every=True).select(
        F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    near = close.select(F.xxhash64("u", "v").alias("bucket"), F.explode(F.array("u", "v")).alias("fp")).join(
        texts.select("fp", "node"), "fp").select("bucket", "node")
    buckets = (texts.select(F.explode("bands").alias("bucket"), "node")
               .unionByName(texts.select(F.xxhash64("fp").alias("bucket"), "node")).unionByName(near))
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("one"), F.max("node").alias("two"))
    shared_by = materialize(buckets.join(sizes.filter("one < two").select("bucket", "size"), "bucket").distinct())
    # the number breaks ties, so that each run picks the same text
    weights = shared_by.groupBy("node").agg((F.sum("size") * 2**20 + F.pmod(F.xxhash64("node"), F.lit(2**20))).alias("weight"))
    members = materialize(shared_by.drop("size").join(weights, "node"))
    leads = members.groupBy("bucket").agg(F.max_by("node", "weight").alias("lead"))
    pairs = materialize(members.select("bucket", "node").join(leads, "bucket").filter("node <> lead").select(
        F.greatest("node", "lead").alias("u"), F.least("node", "lead").alias("v")).distinct())
    asked = members.select("node").distinct().join(held_by.filter("doc_id = least"), "node").select("doc_id", "own", "node")
    # texts move once, whatever the number of candidates; sets of shingles go on
    sets = materialize(docs.select("doc_id", "text", F.xxhash64("text").alias("own")).join(asked.hint("merge"), ["doc_id", "own"])
                       .select("node", shingle_sets(F.col("text"), width).alias("shingles"))
                       .groupBy("node").agg(F.first("shingles").alias("shingles")))

    def confirmed(candidates: DataFrame) -> DataFrame:
        both = candidates.join(sets.toDF("u", "su"), "u").join(sets.toDF("v", "sv"), "v").withColumn(
            "both", F.size(F.array_intersect("su", "sv")))
        return both.filter(F.col("both") / (F.size("su") + F.size("sv") - F.col("both")) >= similarity).select("u", "v")

    shared = held_by.groupBy("doc_id").agg(F.min("node").alias("v"), F.max("node").alias("u")).filter("u <> v")
    links = confirmed(pairs).unionByName(held_by.join(shared.select("doc_id", "v"), "doc_id").select(F.col("node").alias("u"), "v"))
    labels = component_labels(links)
    grouped = materialize(members.select("bucket", "node").join(labels, "node", "left").select(
        "bucket", "node", F.coalesce("component", "node").alias("component")))
    mixed = (grouped.groupBy("bucket").agg(F.min("component").alias("one"), F.max("component").alias("two"))
             .filter("one < two").select("bucket"))
    open_sets = grouped.join(mixed, "bucket").select("node", "component").distinct().join(sets, "node")
    more = confirmed(materialize(close_sets(open_sets, similarity)))
    labels = component_labels(more.unionByName(labels.select(F.col("node").alias("u"), F.col("component").alias("v"))))
    grouped = held_by.join(labels, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component"))
    smallest = grouped.groupBy("component").agg(F.min("doc_id").alias("copy_of"))
    return grouped.distinct().join(smallest, "component").filter("doc_id <> copy_of").select("doc_id", "copy_of").distinct()


def drop_near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of near copies: the smallest ``doc_id`` stays."""
    # stored, so that the planner knows whether the copies are few enough to be sent to all tasks
    copies = materialize(near_duplicates(docs, width, similarity).select("doc_id").distinct())
    gone = free_name(docs.columns, "gone")
    return docs.join(copies.select(F.col("doc_id").alias(gone)), F.col("doc_id") == F.col(gone), "left_anti")


@QUERIES.add("op3_simhash")
def op3(spark, sf):
    groups = simhash_groups(table(spark, sf, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
