import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from semgraph.llm import benchmark, lines, simhash
from tests.llm.against_sql import compare


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# Lines -----------------------------------------------------------------------------------------

LONG = "This very line is long enough"


def test_lines_edge_cases(spark):
    rows = [(1, f"{LONG}\nown"), (2, f"  {LONG.upper()}\t\nb\n{LONG}"), (3, LONG), (4, None), (5, ""), (None, LONG),
            (3, LONG), (6, "short\nshort"), (7, f"{LONG}É"), (8, f"{LONG}é"), (9, f"{LONG}É")]
    docs = frame(spark, rows).withColumn("n_lines", F.lit("own")).withColumn("drop", F.lit(1))
    out = {(r.doc_id, r.text): r for r in lines.drop_lines(docs).collect()}
    assert (1, "own") in out and out[1, "own"]["_n_dropped" if "_n_dropped" in docs.columns else "n_dropped"] == 1
    assert out[2, "b"]["_n_lines"] == 3 and out[2, "b"].n_lines == "own"
    assert (3, LONG) in out and (None, LONG) in out and (4, "") in out and (5, "") in out
    assert (7, f"{LONG}É") in out and (8, f"{LONG}é") in out
    assert lines.drop_lines(docs).count() == len(rows)
    assert lines.drop_lines(docs.limit(0)).count() == 0


def test_lines_against_sql(spark, small_sf):
    compare(spark, small_sf, lines.QUERIES, "op1_line_dedup")


# Benchmark -------------------------------------------------------------------------------------

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, width):
    found = {}
    for doc, text in docs:
        words, hits, ids = words_of(text), set(), set()
        for item, body in items:
            own = words_of(body)
            n = min(width, len(own))
            windows = {tuple(own[i:i + n]) for i in range(len(own) - n + 1)} if own else set()
            for i in range(len(words) - n + 1 if own else 0):
                if tuple(words[i:i + n]) in windows:
                    hits |= set(range(i, i + n))
                    ids.add(item)
        found[doc] = (len(words), sorted(hits), sorted(i for i in ids if i is not None))
    return found


@pytest.mark.parametrize("block", [100_000, 40])
def test_contamination_against_brute_force(spark, block):
    rng = random.Random(3)
    letters = ["a", "b", "c", "é", "9z", "Q"]
    items = [(i, " ".join(rng.choices(letters, k=rng.choice([2, 4, 9])))) for i in range(12)]
    items += [(50, None), (51, "--"), (None, "a b c a b")]
    docs = [(i, ", ".join(rng.choices(letters, k=rng.choice([0, 3, 60])))) for i in range(25)] + [(90, None), (91, "x")]
    marked = benchmark.contamination(frame(spark, docs).withColumn("found", F.lit(0)),
                                     spark.createDataFrame(items, "item_id long, text string"), 4, block)
    got = {r.doc_id: (r["_found"].n_words, list(r["_found"].hits), list(r["_found"].items)) for r in marked.collect()}
    assert got == brute(docs, items, 4)


def test_decontaminate(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    text = "Start, one two THREE four five six-seven eight nine ten. End"
    docs = frame(spark, [(1, text), (2, "clean é\n"), (3, None)])
    assert {r.doc_id for r in benchmark.decontaminate(docs, items).collect()} == {2, 3}
    cut = {r.doc_id: r.text for r in benchmark.decontaminate(docs, items, "spans").collect()}
    assert cut == {1: "Start, . End", 2: "clean é\n", 3: None}
    assert benchmark.decontaminate(docs, items.limit(0)).count() == 3
    assert benchmark.decontaminate(docs.limit(0), items).count() == 0


def test_contamination_against_sql(spark, small_sf):
    compare(spark, small_sf, benchmark.QUERIES, "op5_decontamination")


# SimHash ---------------------------------------------------------------------------------------


def brute_print(text, width):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(values)):
        for j in range(i):
            if ((values[i] ^ values[j]) & (2**64 - 1)).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_simhash_query_against_brute_force(spark, small_sf):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{small_sf}/documents.parquet").collect())
    prints = [brute_print(t, 3) for _, t in docs]
    want = {(d, f"{p:016x}", docs[g][0]) for (d, _), p, g in zip(docs, prints, groups(prints))}
    assert {tuple(r) for r in simhash.op3(spark, small_sf).collect()} == want


@pytest.mark.parametrize("tree_nodes", [2048, 3])
def test_links_against_brute_force(spark, tree_nodes):
    rng = random.Random(5)
    values = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(12):
            value = base
            for b in rng.sample(range(64), rng.choice([0, 1, 1, 2, 3])):
                value ^= 1 << b
            values.add(value - 2**63)
    values = sorted(values)
    labels = groups(values)
    edges = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in values], "fp long"), 2, tree_nodes).collect()
    assert all(((r.u ^ r.v) & (2**64 - 1)).bit_count() <= (2 if tree_nodes > 3 else 2) for r in edges)
    at = {v: i for i, v in enumerate(values)}
    root = list(range(len(values)))
    for r in edges:
        a, b = root[at[r.u]], root[at[r.v]]
        root = [min(a, b) if x in (a, b) else x for x in root]
    assert root == labels


def test_simhash_nulls_ties_and_long_texts(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "a b"), (4, "x y " * 60_000), (None, "lone text here indeed")]
    out = {(r.doc_id, r.component_id) for r in simhash.simhash_groups(frame(spark, rows)).collect()}
    assert out == {(1, 1), (2, 1), (3, 3), (None, 3), (4, 4), (None, None)}
    assert simhash.simhash_groups(frame(spark, rows).limit(0)).count() == 0
    assert simhash.fingerprint(simhash.shingle_hashes("x y " * 60_000, 3)) - 0 == np.int64(
        np.uint64(brute_print("x y " * 60_000, 3)).astype(np.int64))


def test_near_duplicates(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(900)]
    base = [rng.choices(vocabulary, k=150) for _ in range(30)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    close, far = [], []
    for i, words in enumerate(base):
        near = list(words)
        near[70] = "changed"
        rows.append((100 + i, " ".join(near)))
        close.append(100 + i)
        other = words[:75] + rng.choices(vocabulary, k=75)
        rows.append((200 + i, " ".join(other)))
        far.append(200 + i)
    rows += [(300, rows[0][1]), (301, None), (302, ""), (None, rows[1][1])]
    docs = frame(spark, rows).withColumn("gone", F.lit(1))
    found = {r.doc_id: r.copy_of for r in simhash.near_duplicates(docs).collect()}
    assert found == {**{100 + i: i for i in range(30)}, 300: 0, 302: 301}
    left = simhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns and left.count() == len(rows) - 32
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_whose_original_is_not_the_smallest(spark):
    rng = random.Random(11)
    rows, vocabulary = [], ["".join(rng.choices("abcdefgh", k=5)) for _ in range(900)]
    for group in range(12):
        words = rng.choices(vocabulary, k=200)
        for copy in range(6):
            # three words apart make 0.86 of the original, 0.73 of one another
            near = list(words)
            for at in range(10 + copy * 10, 200, 66):
                near[at] = f"changed{copy}"
            rows.append((group * 10 + copy, " ".join(near)))
        rows.append((1000 + group, " ".join(words)))
    docs = frame(spark, rows)
    sketched = {r.doc_id: r.s for r in docs.select("doc_id", simhash.sketches(F.col("text"), 5).alias("s")).collect()}
    own = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in rows}
    root = {i: i for i, _ in rows}
    for a in root:
        for b in root:
            candidates = (((sketched[a].fp ^ sketched[b].fp) & (2**64 - 1)).bit_count() <= 2
                          or set(sketched[a].bands) & set(sketched[b].bands))
            if candidates and len(own[a] & own[b]) >= 0.8 * len(own[a] | own[b]):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    want = {i: r for i, r in root.items() if i != r}
    assert {want[1000 + g] for g in range(12)} == {10 * g for g in range(12)}
    assert {r.doc_id: r.copy_of for r in simhash.near_duplicates(docs).collect()} == want


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_close_sets_finds_all_and_few_others(spark):
    rng = random.Random(4)
    sets = {}
    for family in range(8):
        core = [rng.getrandbits(60) for _ in range(rng.choice([1, 9, 60, 200]))]
        for _ in range(25):
            lost = rng.choice([0, 0.02, 0.05, 0.1, 0.2, 0.4]) * len(core)
            own = set(rng.sample(core, int(len(core) - lost))) | {rng.getrandbits(60) for _ in range(int(rng.random() * lost) + 1)}
            sets[len(sets)] = own
    component = {i: i // 3 for i in sets}
    rows = [(i, component[i], sorted(v)) for i, v in sets.items()]
    found = {tuple(r) for r in simhash.close_sets(spark.createDataFrame(rows, "node long, component long, shingles array<long>"), 0.8).collect()}
    close = {(u, v) for u in sets for v in sets if v < u and component[u] != component[v] and jaccard(sets[u], sets[v]) >= 0.8}
    assert close and close <= found and all(component[u] != component[v] and v < u for u, v in found)


def test_unlike_texts_of_one_template_are_not_paired(spark):
    rng = random.Random(8)
    core = [rng.getrandbits(60) for _ in range(140)]
    for size in (100, 400):
        rows = [(i, i, core + [rng.getrandbits(60) for _ in range(rng.randint(28, 60))]) for i in range(size)]
        found = simhash.close_sets(spark.createDataFrame(rows, "node long, component long, shingles array<long>"), 0.8)
        assert found.count() < size


def test_rows_that_share_an_id(spark):
    rng = random.Random(13)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(900)]
    one, two, three = (" ".join(rng.choices(vocabulary, k=120)) for _ in range(3))
    rows = [(1, one), (1, two), (2, two + " more"), (3, three), (4, "other " + one), (5, three), (5, "lone"), (6, "lone"), (6, "lone")]
    docs = frame(spark, rows).withColumns({"node": F.lit("x"), "a": F.lit(1), "own": F.lit(2)})
    assert {r.doc_id: r.copy_of for r in simhash.near_duplicates(docs).collect()} == {2: 1, 4: 1, 5: 3, 6: 3}
    assert sorted((r.doc_id, r.text) for r in simhash.drop_near_duplicates(docs).collect()) == sorted([rows[0], rows[1], rows[3]])


def test_all_pairs_of_fingerprints(spark):
    rng = random.Random(6)
    values = {0, 3, 12, 1 << 63}
    for _ in range(40):
        values.add(sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3]))))
    values = sorted(v - 2**63 for v in values)
    want = {(u, v) for u in values for v in values if v < u and ((u ^ v) & (2**64 - 1)).bit_count() <= 2}
    for tree_nodes in (2048, 3):
        edges = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in values], "fp long"), 2, tree_nodes, every=True)
        assert {(max(r), min(r)) for r in edges.collect()} == want
