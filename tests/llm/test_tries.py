import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from semgraph.llm import tries
from tests.llm.against_sql import compare

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def rebuilt(rows, family=20, most=4):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    lists = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % most for c in lists}
    return {c: tuple(lists.get(c - c % family, [])[:h[c]] + lists[c][h[c]:]) for c in lists}


def brute(lists):
    members = defaultdict(list)
    for conv, turns in lists.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(conv)
    below = defaultdict(set)
    for node in members:
        if node:
            below[node[:-1]].add(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, convs in members.items():
        words = len(node[-1][1].encode().split()) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not below[node]
            saved[node[:d]] += (len(convs) - 1) * words
    return {(min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(below[node]), leaves[node],
             saved[node], hashlib.sha256(",".join(str(c) for c in sorted(convs) if lists[c] == node).encode()).hexdigest())
            for node, convs in members.items()}


def check(spark, rows, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = tries.prefix_trie(tries.shared_openings(tries.turn_lists(frame(spark, rows)))).select(*COLUMNS).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 2)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = brute(rebuilt(rows))
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def talks(seed, convs, texts, longest):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant", None]), rng.choice(texts))
            for c in rng.sample(range(-5, 3 * convs), convs) for t in range(rng.randint(1, longest))]


@pytest.mark.parametrize("seed, parts", [(0, 1), (1, 3), (2, 8), (3, 25)])
def test_trie_is_that_of_all_prefixes(spark, seed, parts):
    rows = talks(seed, 120, ["", None, "one word", "two words\there", "a"], 4)
    check(spark, rows, parts)


def test_copies_spread_over_ranges(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 4000, 20) for t in range(3)]
    rows += [(c, 0, "user", f"turn {c % 3}") for c in range(7, 300, 20)]
    rows += [(c + 10_000, *rest) for c, *rest in talks(5, 40, ["x", "y z"], 3)]
    check(spark, rows, 9)


def test_nulls_ties_and_repeats(spark):
    rows = [(None, 1, "user", "gone"), (1, None, None, None), (1, 0, "user", "b"), (1, 0, "user", "b"),
            (2, 3, "user", "x " * 50_000), (2, None, "", ""), (40, 1, "user", "only"), (41, 1, "user", "own")]
    check(spark, rows, 4)
    check(spark, rows[:2], 2)
    clash = frame(spark, rows).selectExpr("*", "1 AS key", "'x' AS turns", "2 AS head", "3 AS head_id", "4 AS t", "5 AS depth")
    plain = tries.prefix_trie(tries.shared_openings(tries.turn_lists(frame(spark, rows))))
    other = tries.prefix_trie(tries.shared_openings(tries.turn_lists(clash)))
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, other.collect()), key=str)
    assert tries.prefix_trie(tries.turn_lists(frame(spark, []))).count() == 0


def test_ties_have_one_order(spark):
    rows = [(1, 5, "user", text) for text in ("b", "a", "c")]
    lists = [[tuple(t) for t in frame(spark, order).transform(tries.turn_lists).first().turns] for order in (rows, rows[::-1])]
    assert lists[0] == lists[1]


def test_long_lists():
    rng = np.random.default_rng(1)
    sizes = np.array([0, 50_000, 50_000, 3])
    a = rng.integers(0, 9, sizes.sum())
    a[50_000:100_000] = a[:50_000]
    a[60_000:] += 1
    lcp = tries.neighbour_lcp(np.concatenate([[0], np.cumsum(sizes)])[:-1], sizes, a, a)
    assert lcp.tolist()[:3] == [0, 0, 10_000]


def test_trie_against_sql(spark, small_sf, sf):
    compare(spark, small_sf, tries.QUERIES, "op12_prefix_trie")
    compare(spark, sf, tries.QUERIES, "op12_prefix_trie")
