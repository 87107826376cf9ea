import itertools
import random

import pytest
from pyspark.sql import functions as F

from semgraph.operators.components import connected_components
from semgraph.operators.graph_build import (clean_relations, dedupe_entities, delete_entities,
                                            entity_id_map, ingest_stats, merge_relations,
                                            rewrite_endpoints, upsert_entities)
from semgraph.operators.graph_query import (all_paths, graph_query, graph_stats, neighbors,
                                            search_entities, shortest_path, shortest_paths)
from semgraph.operators.text_index import candidates, search_indexed, write_text_index
from semgraph.operators.triples import entity_uri, join_order, match_triples, read_triples, to_triples, triple_stats, write_triples
from semgraph.session import unsorted_writes
from semgraph.sources.graph_tables import read_graph, write_graph
from semgraph.sources.records import list_files, preview_files, read_records
from semgraph.operators.usage import label_cache_hits
from semgraph.streaming.cache_hits import stream_label_cache_hits
from semgraph.streaming.dedupe import first_entities, stream_dedupe_entities

ENTITY = "workspace_id string, id string, type string, props map<string,string>, seq long"
RELATION = "workspace_id string, source_id string, target_id string, type string, props map<string,string>, seq long"


def edges_of(spark, pairs, kind="E", ws="w"):
    return spark.createDataFrame([(ws, a, b, kind, {}, i) for i, (a, b) in enumerate(pairs)], RELATION)


def nodes_of(spark, names, ws="w"):
    return spark.createDataFrame([(ws, n, "T", {"name": n}, i) for i, n in enumerate(names)], ENTITY)


def test_dedupe_first_wins_per_workspace(spark):
    df = spark.createDataFrame([
        ("w", "2", "T", {"a": " X ", "b": "y"}, 2), ("w", "1", "U", {"b": "Y", "a": "x"}, 1),
        ("v", "3", "T", {"a": "x", "b": "y"}, 0), ("w", "4", "T", {"a": "xy"}, 3)], ENTITY)
    assert {r["id"] for r in dedupe_entities(df).collect()} == {"1", "3", "4"}
    ids = {r["id"]: r["kept_id"] for r in entity_id_map(df).collect()}
    assert ids == {"1": "1", "2": "1", "3": "3", "4": "4"}
    rel = edges_of(spark, [("2", "4")])
    assert rewrite_endpoints(rel, entity_id_map(df)).first()["source_id"] == "1"


def test_one_hot_group_of_copies(spark):
    rows = spark.range(3000).select(
        F.lit("w").alias("workspace_id"), F.col("id").cast("string").alias("id"),
        F.lit("T").alias("type"),
        F.create_map(F.lit("k"), F.when(F.col("id") % 3 == 0, "hot").otherwise(
            F.col("id").cast("string"))).alias("props"), F.col("id").alias("seq"))
    assert dedupe_entities(rows).count() == 2001
    assert entity_id_map(rows).filter("kept_id = '0'").count() == 1000


def test_relations_clean_and_merge(spark):
    raw = spark.createDataFrame([("a", None, "b", None), (None, "c", "d", "R"), (None, None, "e", "R"),
                                 ("", "", "e", "R")],
                                "source_id string, source string, target_id string, type string")
    got = {(r["source_id"], r["target_id"], r["type"]) for r in clean_relations(raw).collect()}
    assert got == {("a", "b", "RELATED_TO"), ("c", "d", "R")}
    rel = spark.createDataFrame([("w", "a", "b", "R", {"n": "1"}, 1), ("w", "a", "b", "R", {"n": "2"}, 2),
                                 ("w", "a", "b", "S", {"n": "3"}, 3)], RELATION)
    for keep, n in (("first", "1"), ("last", "2")):
        merged = {r["type"]: r["props"]["n"] for r in merge_relations(rel, keep).collect()}
        assert merged == {"R": n, "S": "3"}


def test_upsert_modes(spark):
    base = spark.createDataFrame([("w", "1", "T", {"a": "1", "b": "1"}, 9), ("w", "2", "T", {}, 9)], ENTITY)
    new = spark.createDataFrame([("w", "1", "U", {"b": "2"}, 1), ("w", "1", "U", {"c": "3"}, 2)], ENTITY)
    replaced = {r["id"]: r["props"] for r in upsert_entities(base, new).collect()}
    assert replaced == {"1": {"c": "3"}, "2": {}}
    merged = {r["id"]: r["props"] for r in upsert_entities(base, new, "merge").collect()}
    assert merged == {"1": {"a": "1", "b": "2", "c": "3"}, "2": {}}


def test_delete_and_stats(spark):
    entities, relations = nodes_of(spark, "abc"), edges_of(spark, [("a", "b"), ("b", "c"), ("c", "z")])
    for ids in (["b"], spark.createDataFrame([("b",)], "id string")):
        left, rel = delete_entities(entities, relations, ids)
        assert left.count() == 2 and [r["target_id"] for r in rel.collect()] == ["z"]
    stats = graph_stats(entities, relations).first()
    assert (stats["nodes"], stats["edges"], stats["relations"]) == (4, 3, 3)
    counted = ingest_stats(entities, relations.withColumn(
        "target_id", F.when(F.col("target_id") != "z", F.col("target_id")))).first()
    assert list(counted) == [3, 0, 2, 1]


def test_search_prefers_the_exact_id(spark):
    df = spark.createDataFrame([("w", "ab", "T", {"n": "q"}, 0), ("w", "c", "T", {"n": "xABy"}, 1)], ENTITY)
    assert [r["id"] for r in search_entities(df, "ab").collect()] == ["ab"]
    assert [r["id"] for r in search_entities(df, "B").collect()] == ["ab", "c"]
    assert search_entities(df, "nothing").count() == 0


def test_search_through_an_index(spark, tmp_path):
    rng, path = random.Random(2), str(tmp_path / "i")
    def word():
        return "".join(rng.choices("abAé😀 ", k=rng.randint(0, 9)))
    rows = [(rng.choice("vw"), f"e{i}", "T", {"n": word(), "m": word()}, i) for i in range(120)]
    rows += [("w", None, "T", {"n": "abab aba"}, 0), (None, "aba", None, None, 1), ("w", "x", "T", {"n": None}, 2), ("w", "x", "T", {"n": "aba"}, 3)]
    entities = spark.createDataFrame(rows, ENTITY)
    write_text_index(entities, path)
    for text in ("aba", "ABAB", "a b", "é😀", "é😀a", "bb", "e1", "e11", "x", "nothing", "", "b" * 30):
        for workspace in (None, "w"):
            want = sorted(str(tuple(r)) for r in search_entities(entities, text, None, workspace).collect())
            got = sorted(str(tuple(r)) for r in search_indexed(entities, path, text, None, workspace).collect())
            assert got == want, (text, workspace)
    assert candidates(spark, path, "é😀a").count() < 60 and candidates(spark, path, "ab") is None


def test_neighbors_need_an_entity_row(spark):
    entities = nodes_of(spark, ["person1"])
    relations = edges_of(spark, [("person1", "person2"), ("person1", "person1")], "KNOWS")
    got = {(r["id"], r["direction"]) for r in neighbors(entities, relations, ["person1"]).collect()}
    assert got == {("person1", "out"), ("person1", "in")}
    assert neighbors(entities, relations, types=["OTHER"]).count() == 0
    with pytest.raises(ValueError):
        neighbors(entities, relations, direction="up")


def brute_paths(pairs, start, depth):
    found, queue = [], [[start]]
    while queue:
        path = queue.pop(0)
        if len(path) > 1:
            found.append(tuple(path))
        if len(path) < depth:
            queue += [path + [b] for a, b in sorted(set(pairs)) if a == path[-1] and b not in path]
    return found


@pytest.mark.parametrize("depth", [2, 3, 6])
def test_paths_against_brute_force(spark, depth):
    rng = random.Random(depth)
    pairs = [(rng.choice("abcdef"), rng.choice("abcdef")) for _ in range(9)]
    relations = edges_of(spark, pairs)
    want = brute_paths(pairs, "a", depth)
    got = [tuple(r["path"]) for r in all_paths(relations, ["a"], depth, None).collect()]
    assert sorted(got) == sorted(want)
    asked = spark.createDataFrame([("w", a, b) for a, b in itertools.product("abc", "abcdef")],
                                  "workspace_id string, src string, dst string")
    best = {(r["src"], r["dst"]): tuple(r["path"]) for r in
            shortest_paths(relations, asked, depth).collect()}
    for a, b in itertools.product("abc", "abcdef"):
        options = [(a,)] if a == b else [p for p in brute_paths(pairs, a, depth) if p[-1] == b]
        assert best.get((a, b)) == (min(options, key=lambda p: (len(p), p)) if options else None)


def test_path_depth_counts_nodes(spark):
    relations = edges_of(spark, [("a", "b"), ("b", "c"), ("c", "d")])
    assert shortest_path(relations, "a", "c", workspace="w").first()["length"] == 2
    assert shortest_path(relations, "a", "d", workspace="w").count() == 0
    assert shortest_path(relations, "a", "a", workspace="w").first()["length"] == 0
    assert all_paths(relations, ["a"], 3, 1).collect()[0]["path"] == ["a", "b"]
    found = graph_query(nodes_of(spark, "ab"), relations, "a", "path", "w")
    assert [r["path"] for r in found.collect()] == [["a", "b"]]


def test_components_against_brute_force(spark):
    rng = random.Random(5)
    chain = [("m1", f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)]
    loose = [(f"m{rng.randint(2, 4)}", f"k{rng.randint(0, 30):02d}", f"k{rng.randint(0, 30):02d}")
             for _ in range(45)]
    edges = chain + loose
    nodes = {(m, n) for m, a, b in edges for n in (a, b)} | {("m9", "alone")}
    label = {n: n[1] for n in nodes}
    for _ in range(100):
        for m, a, b in edges:
            label[m, a] = label[m, b] = min(label[m, a], label[m, b])
    got = connected_components(
        spark.createDataFrame(sorted(nodes), "m string, node string"),
        spark.createDataFrame(edges, "m string, u string, v string"), ["m"])
    assert {(r["m"], r["node"]): r["component"] for r in got.collect()} == label


def test_triples(spark):
    entities = spark.createDataFrame([("w", "T:1 a", "T", {"n": 'x"y'}, 0), ("w", "T:2", "T", {}, 1)], ENTITY)
    triples = to_triples(entities, edges_of(spark, [("T:1 a", "T:2")], "R"))
    assert triples.count() == 4 + 1 + 4 + 3
    uri = spark.range(1).select(entity_uri(F.lit("a b*~/é"))).first()[0]
    assert uri == "urn:semgraph/entity/a%20b%2A~%2F%C3%A9"
    found = match_triples(triples, [("?a", "urn:semgraph/relation/R", "?b"),
                                    ("?b", "urn:semgraph/property/id", "?id")], ["id"])
    assert [r["id"] for r in found.collect()] == ["T:2"]
    with pytest.raises(ValueError):
        match_triples(triples, [("?a", "p", "?b"), ("?c", "p", "?d")], ["a"])


def test_triples_are_made_compiled_and_written_unsorted(spark, tmp_path, monkeypatch):
    rows = [("w", "T:1 a", "T", {"n~ ": "x", "k": None}, 0), ("v", "T:2*", None, {}, 1), (None, None, "T", {"n": "y"}, 2), ("w", "T:3", "T", None, 3)]
    edges = [("w", "R é", "T:1 a", "T:2*", "T", "T", {"since": "1"}), ("w", None, "T:3", None, "T", "T", {})]
    triples = to_triples(spark.createDataFrame(rows, ENTITY), spark.createDataFrame(
        edges, "workspace_id string, type string, source_id string, target_id string, source_type string, target_type string, props map<string,string>"))
    entity, prop, relation, graph = (f"urn:semgraph/{part}/" for part in ("entity", "property", "relation", "graph/workspace"))
    kind = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
    want = [("w", "T%3A1%20a", kind, "urn:semgraph/type/T"), ("w", "T%3A1%20a", prop + "id", "T:1 a"), ("w", "T%3A1%20a", prop + "type", "T"),
            ("w", "T%3A1%20a", prop + "workspace_id", "w"), ("w", "T%3A1%20a", prop + "n~%20", "x"), ("w", "T%3A1%20a", prop + "k", None),
            ("v", "T%3A2%2A", kind, None), ("v", "T%3A2%2A", prop + "id", "T:2*"), ("v", "T%3A2%2A", prop + "type", None),
            ("v", "T%3A2%2A", prop + "workspace_id", "v"), (None, None, kind, "urn:semgraph/type/T"), (None, None, prop + "id", None),
            (None, None, prop + "type", "T"), (None, None, prop + "workspace_id", None), (None, None, prop + "n", "y")]
    want = [(g and graph + g, s and entity + s, p, o) for g, s, p, o in want]
    first, second = relation + "T%3A1%20a_T%3A2%2A_R%20%C3%A9", relation + "T%3A3"
    w, edge = graph + "w", relation + "R%20%C3%A9"
    want += [(w, entity + "T%3A1%20a", edge, entity + "T%3A2%2A"), (w, first, prop + "workspace_id", "w"), (w, first, prop + "type", "R é"),
             (w, entity + "T%3A1%20a", edge + "/since", "1"), (w, entity + "T%3A3", None, None),
             (w, second, prop + "workspace_id", "w"), (w, second, prop + "type", None)]
    assert sorted(map(repr, map(tuple, triples.collect()))) == sorted(map(repr, want))
    plan = triples._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "lambdafunction" not in plan

    stats = triple_stats(triples)
    assert sorted(map(repr, map(tuple, stats.collect()))) == sorted(map(repr, [(w, 4, 13), (graph + "v", 1, 4), (None, 0, 5)]))
    plan = stats._jdf.queryExecution().sparkPlan().toString()
    assert "REPARTITION_BY_COL" in plan.split("HashAggregate")[-1]

    name, seen, writer = "spark.sql.maxConcurrentOutputFileWriters", [], type(triples.write)
    write = writer.parquet

    def parquet(self, path, *args, **kwargs):
        seen.append((path.rsplit("/", 1)[-1], spark.conf.get(name)))
        return write(self, path, *args, **kwargs)

    before = spark.conf.get(name)
    monkeypatch.setattr(writer, "parquet", parquet)
    write_triples(triples.coalesce(1), str(tmp_path / "t"))
    write_graph(spark.createDataFrame(rows[:2], ENTITY), edges_of(spark, [("a", "b")]), str(tmp_path / "g"))
    assert seen == [("triples", "64"), ("counts", before), ("entities", "64"), ("relations", "64")] and spark.conf.get(name) == before
    with unsorted_writes(spark, 2):
        triples.coalesce(1).write.partitionBy("graph", "p").parquet(str(tmp_path / "few"))
    for folder in ("t/triples", "few"):
        read = spark.read.schema("graph string, s string, p string, o string").parquet(str(tmp_path / folder))
        assert sorted(map(repr, map(tuple, read.select("graph", "s", "p", "o").collect()))) == sorted(map(repr, want))


def test_patterns_join_in_the_order_of_their_counts(spark, tmp_path):
    sizes = {"big": (10_000, 10_000, 2), "edge": (500, 400, 20), None: (10_500, 10_000, 20)}
    cycle = [("?a", "big", "?w"), ("?b", "big", "?w"), ("?a", "edge", "?b")]
    assert join_order(cycle, sizes) == [cycle[2], cycle[0], cycle[1]]
    assert join_order(cycle) == cycle
    assert join_order([("?x", "?p", "?y"), ("?x", "big", "1")], sizes)[0][1] == "big"
    assert join_order([("?x", "big", "?y"), ("?y", "unknown", "?z")], sizes)[0][1] == "unknown"

    rng = random.Random(4)
    rows = sorted({(rng.choice("gh"), rng.choice("abcdef"), rng.choice("pqr/ %"), rng.choice("abcdef")) for _ in range(150)})
    write_triples(spark.createDataFrame(rows, "graph string, s string, p string, o string"), str(tmp_path / "t"))
    triples, counts = read_triples(spark, str(tmp_path / "t"))
    assert sorted(tuple(r) for r in triples.collect()) == rows
    for patterns in ([("?x", "p", "?y"), ("?y", "q", "?z"), ("?z", " ", "?x")], [("?x", "?k", "?x"), ("?x", "%", "?y")],
                     [("?x", "p", "?y"), ("?y", "?k", "a"), ("?y", "?k", "?x")]):
        want = [("g", {}), ("h", {})]
        for pattern in patterns:
            grown = []
            for graph, known in want:
                for g, *triple in rows:
                    new = dict(known)
                    if g == graph and all(new.setdefault(t, v) == v if t[0] == "?" else t == v for t, v in zip(pattern, triple)):
                        grown.append((g, new))
            want = grown
        names = sorted({t for p in patterns for t in p if t[0] == "?"})
        expected = {(g, *[known[n] for n in names]) for g, known in want}
        for written in itertools.permutations(patterns):
            try:
                join_order(list(written))
            except ValueError:
                continue
            got = match_triples(triples, list(written), [n[1:] for n in names], counts=counts)
            assert {tuple(r) for r in got.collect()} == expected
    only = match_triples(triples, [("?x", "p", "a")], ["x"], graph="g", counts=counts)
    plan = only._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(graph" in plan and "(p#" in plan.split("PartitionFilters", 1)[1].split("]")[0]


def test_graph_tables_prune_workspaces(spark, tmp_path):
    entities = nodes_of(spark, "ab").unionByName(nodes_of(spark, "c", "v"))
    write_graph(entities, edges_of(spark, [("a", "b")]), str(tmp_path / "g"))
    back, _rel = read_graph(spark, str(tmp_path / "g"))
    only = back.filter("workspace_id = 'v'")
    assert [r["id"] for r in only.collect()] == ["c"]
    assert "PartitionFilters: [isnotnull(workspace_id" in only._jdf.queryExecution().executedPlan().toString()


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,t\n1,"x, y"\n2,"say ""hi"""\n')
    (tmp_path / "b.json").write_text('[{"id": 1},\n {"id": 2, "k": "v"}]')
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "e.json").write_text('{"id": 1}\n{"id": 2}\n{"id": 3}\n')
    (tmp_path / "lines" / "f.csv").write_text("id\n4\n5\n")
    (tmp_path / "lines" / "g.txt").write_text("one\ntwo\n")
    (tmp_path / "c.txt").write_text("\n".join(f"l{i}" for i in range(80)))
    (tmp_path / "d.xml").write_text("<rows><row><id>1</id></row><row><id>2</id></row></rows>")
    assert [r["t"] for r in read_records(spark, str(tmp_path / "a.csv")).collect()] == ["x, y", 'say "hi"']
    assert read_records(spark, str(tmp_path / "b.json"), multiLine=True).count() == 2
    assert read_records(spark, str(tmp_path / "lines" / "e.json")).count() == 3
    mixed = read_records(spark, str(tmp_path / "lines"))
    assert sorted((r["id"], r["content"]) for r in mixed.select(F.col("id").cast("string"), "content").na.fill("").collect()) == [
        ("", "one"), ("", "two"), ("1", ""), ("2", ""), ("3", ""), ("4", ""), ("5", "")]
    (tmp_path / "lines" / "h.pdf").write_text("x")
    with pytest.raises(ValueError, match="h.pdf"):
        read_records(spark, str(tmp_path / "lines"))
    assert read_records(spark, str(tmp_path / "c.txt"), wholetext=True).first()["content"].startswith("l0\n")
    assert read_records(spark, str(tmp_path), "xml").count() == 2
    listed = {r["name"]: (r["type"], r["size"]) for r in list_files(spark, str(tmp_path)).collect()}
    assert listed["c.txt"][0] == "text" and listed["a.csv"] == ("csv", 29)
    lines = preview_files(spark, str(tmp_path / "c.txt")).orderBy("line_number").collect()
    assert [r["line"] for r in lines] == [f"l{i}" for i in range(50)]


def test_records_that_cross_lines(spark, tmp_path):
    folder = tmp_path / "of files"
    folder.mkdir()
    (folder / "a.csv").write_text('k,t\n1,"two\nlines, ""here"""\n2,"\n"\n')
    (folder / "b.csv").write_text('k,t\n3,plain\n4,"quo""ted"\n')
    (folder / "c.json").write_text('[\n  {"k": 5,\n   "t": "x"},\n  {"k": 6, "t": "y"}\n]\n')
    (folder / "d.json").write_text('{"k": 7, "t": "z"}\nbroken {\n\n{"k": 8, "t": "w"}\n')
    (folder / "e.json").write_text('\n{\n "k": 9, "t": "v"\n}\n')
    csv = read_records(spark, str(folder), "csv", schema="k string, t string")
    assert {(r.k, r.t) for r in csv.collect()} == {("1", 'two\nlines, "here"'), ("2", "\n"), ("3", "plain"), ("4", 'quo"ted')}
    json_rows = read_records(spark, str(folder), "json", schema="k string, t string").filter("k IS NOT NULL")
    assert {(r.k, r.t) for r in json_rows.collect()} == {("5", "x"), ("6", "y"), ("7", "z"), ("8", "w"), ("9", "v")}
    one = read_records(spark, str(folder / "a.csv"))
    assert one.count() == 2 and one.columns == ["k", "t", "source"]
    assert read_records(spark, str(folder / "a.csv"), multiLine=False).count() > 2


def test_stream_dedupe_remembers_earlier_batches(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        stream = spark.readStream.schema(ENTITY).parquet(source)
        query = (stream_dedupe_entities(stream).writeStream.format("parquet")
                 .option("checkpointLocation", str(tmp_path / "state"))
                 .trigger(availableNow=True).start(out))
        query.awaitTermination()

    nodes_of(spark, "ab").write.parquet(source)
    run()
    nodes_of(spark, "bcc").withColumn("id", F.concat(F.lit("x"), "id")).write.mode("append").parquet(source)
    run()
    kept = sorted(r["props"]["name"] for r in spark.read.parquet(out).collect())
    assert kept == ["a", "b", "c"]


def brute_runs(rows, gap):
    """``(smallest seq, copies, last second)`` of each run of rows ``seq, name, second``."""
    out = []
    for name in {r[1].strip().lower() for r in rows}:
        run = []
        for seq, _n, s in sorted((r for r in rows if r[1].strip().lower() == name and r[2] is not None), key=lambda r: r[2]):
            if run and s - run[-1][1] > gap:
                out.append((min(run)[0], len(run), run[-1][1]))
                run = []
            run.append((seq, s))
        out += [(min(run)[0], len(run), run[-1][1])] if run else []
    return sorted(out)


def test_first_entities_of_runs(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "A ", "b", "c"]), float(rng.randint(0, 4000))) for i in rng.sample(range(300), 300)]
    rows += [(300, "z", 0.0), (301, "z", 100.0), (302, "z", 200.001), (303, "z", None)]
    want = brute_runs(rows, 100)
    assert {(300, 2, 100.0), (302, 1, 200.001)} <= set(want)

    def entities(part):
        return spark.createDataFrame(part, "seq long, name string, s double").select(
            F.lit("w").alias("workspace_id"), F.col("seq").cast("string").alias("id"), F.lit("T").alias("type"),
            F.create_map(F.lit("name"), "name").alias("props"), "seq",
            F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias("ts"))

    def found(df):
        return sorted((r["seq"], r["n_copies"], round(r["at"] / 1e6, 3)) for r in
                      df.withColumn("at", F.unix_micros("last_ts")).collect())

    assert found(first_entities(entities(rows), gap="100 seconds")) == want
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows.sort(key=lambda r: (r[2] or 0) + rng.random() * 500)
    for at in range(0, len(rows), 40):
        entities(rows[at:at + 40]).coalesce(1).write.mode("append").parquet(source)
    entities([(999, "closing", 1e6)]).write.mode("append").parquet(source)
    stream = spark.readStream.schema(entities(rows).schema).option("maxFilesPerTrigger", 1).parquet(source)
    (first_entities(stream, gap="100 seconds", delay="501 seconds").writeStream.format("parquet")
     .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(out).awaitTermination())
    assert found(spark.read.parquet(out)) == want


def label_stream(spark, folder, rows, files, runs=1, delay="305 seconds"):
    """Rows ``request_id, request_key, second`` in their order of arrival, as ``files`` micro-batches."""
    source, out, settings = str(folder / "in"), str(folder / "out"), {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "50"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        size = -(-len(rows) // files)
        for run in range(runs):
            for at in range(run * files // runs, (run + 1) * files // runs):
                (spark.createDataFrame(rows[at * size:(at + 1) * size], "request_id long, request_key string, s double").coalesce(1)
                 .select("request_id", "request_key", F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias("ts"))
                 .write.mode("append").parquet(source))
            calls = (spark.readStream.schema("request_id long, request_key string, ts timestamp")
                     .option("maxFilesPerTrigger", 1).parquet(source))
            (stream_label_cache_hits(calls, 100, delay=delay, slot=20).writeStream.format("parquet")
             .option("checkpointLocation", str(folder / "state")).trigger(availableNow=True).start(out).awaitTermination())
    finally:
        for name in settings:
            spark.conf.unset(name)
    return {r["request_id"]: r["cached"] for r in spark.read.parquet(out).collect()}


CLOSING = (-1, "closing", 1e6)


def test_stream_cache_hits_in_any_order(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.choice("aab"), round(rng.random() * 3000, rng.choice([0, 1, 3]))) for i in range(900)]
    rows.sort(key=lambda r: r[2] + rng.random() * 300)
    got = label_stream(spark, tmp_path, rows + [CLOSING], 10, runs=2)
    log = spark.createDataFrame(rows, "request_id long, request_key string, s double").select(
        "request_id", "request_key", F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias("ts"))
    want = {r["request_id"]: r["cached"] for r in label_cache_hits(log, 100).collect()}
    assert got == want and len(got) == 900 and len({v for v in got.values()}) == 2


def test_stream_cache_hits_of_an_older_request(spark, tmp_path):
    rows = [(1, "k", 18_000.0), (2, "k", 17_700.0), (3, "k", None), (4, "k", 17_799.999), (5, "k", 17_800.0), CLOSING]
    assert label_stream(spark, tmp_path, rows, 6) == {2: False, 4: True, 5: False, 1: False, 3: None}
