import random
import copy
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from semgraph.operators.diff import diff_models, diff_summary
from semgraph.operators.drift import (append_drift, definition_drift, drift_events, mapping_drift,
                                      table_columns)
from semgraph.operators.gates import evaluate_models, gate_summary
from semgraph.operators.model_graphs import ambiguous_pairs, graph_shape
from semgraph.operators.history import activate, cached_diff, history, latest, soft_delete, upsert
from semgraph.operators.quality import schema_quality
from semgraph.operators.registry_checks import structure_errors, validate_models
from semgraph.operators.regression import evaluate_answers, regression_summary
from semgraph.operators.usage import label_cache_hits, miss_instants, request_cost, usage_stats
from semgraph.session import materialize
from semgraph.sources.models import explode_model, fingerprint, parse_models, read_models
from semgraph.sources.ontology import Ontology

GOOD = {
    "version": "1.0.0", "name": "shop",
    "objects": [
        {"name": "Order", "identifiers": ["id"], "properties": [
            {"name": "id", "type": "string"}, {"name": "customer_id", "type": "string"},
            {"name": "amount", "type": "decimal"}]},
        {"name": "Customer", "identifiers": ["id"], "properties": [
            {"name": "id", "type": "string"}, {"name": "email", "type": "string"},
            {"name": "age", "type": "integer"}]}],
    "relationships": [{"name": "placed_by", "from": "Order", "to": "Customer",
                       "joinKeys": [["customer_id", "id"]]}],
    "metrics": [{"name": "Total", "expression": "SUM(Order.amount)", "grain": ["Order"], "type": "sum"}],
    "dimensions": [{"name": "Email", "sourceProperty": "Customer.email"}],
    "snowflake": {"database": "db", "schema": "s", "tableMappings": {"Order": "orders"}},
}


def changed(change):
    doc = copy.deepcopy(GOOD)
    change(doc)
    return doc


def docs(spark, models, version="1"):
    return parse_models(spark.createDataFrame(
        [(k, version, json.dumps(d)) for k, d in models.items()],
        "model_id string, version_id string, raw string"))


def registry(spark, models, version="1"):
    return explode_model(docs(spark, models, version))


def test_normal_form(spark):
    def shuffle(d):
        d["objects"][0]["identifiers"] = ["z", "a"]
        d["relationships"][0]["joinKeys"] = [["x", "y"], ["a", "b"]]
        d["objects"].append({"name": "Alpha"})
    reg = registry(spark, {"m": changed(shuffle)})
    objects = {r["name"]: r for r in reg.objects.collect()}
    assert [objects[n]["ord"] for n in ("Alpha", "Customer", "Order")] == [0, 1, 2]
    assert objects["Order"]["identifiers"] == ["a", "z"] and objects["Order"]["table"] == "orders"
    assert objects["Customer"]["table"] == "customer" and objects["Alpha"]["pos"] == 2
    rel = reg.relationships.first()
    assert [tuple(k) for k in rel["join_keys"]] == [("a", "b"), ("x", "y")]
    assert rel["cardinality"] == "many_to_one"
    assert reg.properties.filter("nullable and not required").count() == 6


BROKEN = {
    "from": lambda d: d["relationships"][0].update({"from": "Ghost"}),
    "grain": lambda d: d["metrics"][0].update(grain=["Ghost"]),
    "dimension": lambda d: d["dimensions"][0].update(sourceProperty="Ghost.x"),
    "format": lambda d: d["dimensions"][0].update(sourceProperty="email"),
    "duplicate": lambda d: d["metrics"].append(dict(d["metrics"][0])),
    "cardinality": lambda d: d["relationships"][0].update(cardinality="some"),
    "join_key": lambda d: d["relationships"][0].update(joinKeys=[["nope", "id"]]),
}


def test_each_error_class_has_its_finding(spark):
    models = {"good": GOOD, **{k: changed(c) for k, c in BROKEN.items()}}
    found = {}
    for r in validate_models(registry(spark, models)).collect():
        found.setdefault(r["model_id"], []).append((r["rule"], r["path"]))
    assert {model: sorted(rules) for model, rules in found.items()} == {
        "from": [("join_key", "relationships[0].joinKeys[0][0]"), ("reference", "relationships[0].from")],
        "grain": [("reference", "metrics[0].grain[0]")],
        "dimension": [("reference", "dimensions[0].sourceProperty")],
        "format": [("reference", "dimensions[0].sourceProperty")],
        "duplicate": [("duplicate", "metrics[1].name")],
        "cardinality": [("cardinality", "relationships[0].cardinality")],
        "join_key": [("join_key", "relationships[0].joinKeys[0][0]")],
    }


def test_schema_level(spark):
    def spoil(d):
        d["version"] = "1.0"
        d["objects"][0]["name"] = "order"
        d["objects"][1]["properties"][0]["type"] = "varchar"
        d["metrics"][0]["grain"] = []
    rules = {(r["rule"], r["path"]) for r in
             validate_models(registry(spark, {"m": changed(spoil)}), "schema").collect()}
    assert {("pattern", "version"), ("pattern", "objects[0].name"), ("required", "metrics[0].grain"),
            ("enum", "objects[Customer].properties[0].type")} <= rules


def test_structure(spark):
    raw = spark.createDataFrame([
        ("none", "1", "{}"), ("empty", "1", '{"version": "1", "objects": []}'),
        ("map", "1", '{"version": "1", "objects": {}}'), ("null", "1", '{"version": "1", "objects": null}'),
        ("fine", "1", '{"version": "1", "objects": [{}]}')], "model_id string, version_id string, raw string")
    found = {(r["model_id"], r["path"], r["value"]) for r in structure_errors(raw).collect()}
    assert found == {("none", "version", None), ("none", "objects", None), ("empty", "objects", None),
                     ("map", "objects", "dict"), ("null", "objects", "NoneType")}


def test_gates(spark):
    def lonely(d):
        d["objects"].append({"name": "Alone"})

    def parallel(d):
        d["relationships"].append({**d["relationships"][0], "name": "again"})

    def unmapped(d):
        del d["snowflake"]

    def split(d):
        d["relationships"] = []
    models = {"good": GOOD, "lonely": changed(lonely), "parallel": changed(parallel),
              "unmapped": changed(unmapped), "split": changed(split),
              "keys": changed(BROKEN["join_key"]), "grain": changed(BROKEN["grain"])}
    reg = registry(spark, models).map(materialize)
    gates = evaluate_models(reg, "strict")
    failed = {}
    for r in gates.filter("status = 'fail'").collect():
        failed.setdefault(r["model_id"], {})[r["gate"]] = r["n_findings"]
    assert failed == {
        "lonely": {"connected_join_graph": 1}, "parallel": {"no_ambiguous_joins": 1},
        "unmapped": {"mapping_complete": 1}, "split": {"connected_join_graph": 2},
        "keys": {"no_ambiguous_joins": 1},
        "grain": {"references_resolved": 1, "metric_grains_consistent": 1}}
    verdict = {r["model_id"]: r["overall_pass"] for r in gate_summary(gates).collect()}
    assert verdict == {m: m == "good" for m in models}
    relaxed = gate_summary(evaluate_models(reg, "relaxed"), strict=False)
    passing = {r["model_id"] for r in relaxed.filter("overall_pass").collect()}
    assert passing == {"good", "parallel", "unmapped", "keys"}
    unbound = spark.createDataFrame([("good", "1")], "model_id string, version_id string")
    good = reg.version(F.col("model_id") == "good")
    bound = evaluate_models(good, {"connected_join_graph": "skip"}, unbound)
    status = {r["gate"]: r["status"] for r in bound.collect()}
    assert status["model_binds"] == "fail" and status["connected_join_graph"] == "skip"


CHANGES = {
    "object_added": lambda d: d["objects"].append({"name": "New"}),
    "object_removed": lambda d: d["objects"].pop(1),
    "object_description_changed": lambda d: d["objects"][0].update(description="x"),
    "identifier_added": lambda d: d["objects"][0].update(identifiers=["id", "b"]),
    "identifier_removed+identifier_changed": lambda d: d["objects"][0].update(identifiers=["b"]),
    "property_added": lambda d: d["objects"][0]["properties"].append({"name": "n", "type": "string"}),
    "property_removed": lambda d: d["objects"][0]["properties"].pop(),
    "property_type_changed": lambda d: d["objects"][0]["properties"][0].update(type="integer"),
    "relationship_removed": lambda d: d["relationships"].pop(),
    "relationship_join_keys_changed": lambda d: d["relationships"][0].update(joinKeys=[["id", "id"]]),
    "relationship_cardinality_tightened": lambda d: d["relationships"][0].update(cardinality="one_to_one"),
    "relationship_cardinality_relaxed": lambda d: d["relationships"][0].update(cardinality="many_to_many"),
    "metric_expression_changed": lambda d: d["metrics"][0].update(expression="1"),
    "metric_grain_changed": lambda d: d["metrics"][0].update(grain=["Customer"]),
    "dimension_removed": lambda d: d["dimensions"][0].update(sourceProperty="Order.id"),
    "": lambda d: d["relationships"][0].update(cardinality="one_to_many"),
}


def test_each_change_class(spark):
    names = list(CHANGES)
    old = registry(spark, {f"m{i}": GOOD for i in range(len(names))})
    new = registry(spark, {f"m{i}": changed(CHANGES[n]) for i, n in enumerate(names)}, "2")
    changes = diff_models(old, new)
    found = {}
    for r in changes.collect():
        found.setdefault(r["model_id"], set()).add(r["category"])
    assert found == {f"m{i}": set(n.split("+")) for i, n in enumerate(names) if n}
    summary = {r["model_id"]: r["total_changes"] for r in diff_summary(changes, old.models).collect()}
    assert summary["m15"] == 0 and summary["m4"] == 2


def test_cached_diff_computes_only_misses(spark):
    both = registry(spark, {"a": GOOD, "b": GOOD})
    later = registry(spark, {"a": changed(CHANGES["object_added"]), "b": changed(CHANGES["object_added"])}, "2")
    versions = type(both)(*[getattr(both, f).unionByName(getattr(later, f)) for f in
                            ("models", "objects", "properties", "relationships", "metrics", "dimensions")])
    schema = ("model_id string, old_version string, new_version string, category string, change_type string,"
              " element_name string, old_value string, new_value string")
    stored = spark.createDataFrame([("a", "1", "2", "known", "breaking", "x", None, None)], schema)
    pairs = spark.createDataFrame([("a", "1", "2"), ("b", "1", "2")],
                                  "model_id string, old_version string, new_version string")
    got = {(r["model_id"], r["category"]) for r in cached_diff(stored, pairs, versions).collect()}
    assert got == {("a", "known"), ("b", "object_added")}


def test_mapping_drift_reports_a_rename_three_times(spark):
    reg = registry(spark, {"m": GOOD})
    tables = {"customer": spark.createDataFrame([], "id string, email_address string, age bigint")}
    events = mapping_drift(reg, table_columns(spark, tables, "db", "s")).collect()
    got = {(r["event_type"], r["element_name"], r["detail"], r["other"]) for r in events}
    assert got == {("table_missing", "Order", "orders", None),
                   ("column_missing", "Customer", "email", "string"),
                   ("column_added", "Customer", "email_address", "string"),
                   ("column_renamed", "Customer", "email", "email_address")}


def test_definition_drift_flags_large_divergence(spark, tmp_path):
    other = {"version": "1.0.0", "objects": [{"name": n} for n in "VWXYZ"], "metrics": [
        {"name": "Total", "expression": "COUNT(1)", "grain": ["V"]}]}
    events = definition_drift(registry(spark, {"m": other}), registry(spark, {"m": GOOD}))
    kinds = [r["event_type"] for r in events.collect()]
    assert kinds.count("yaml_divergence") == 3 and kinds.count("manual_edit_detected") == 7
    append_drift(events, str(tmp_path / "log"), datetime(2024, 1, 1))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert drift_events(log, "m", "open", 4).count() == 4
    assert drift_events(log, "m", "closed").count() == 0


def test_history(spark):
    base = spark.createDataFrame([("a", 1, True), ("b", 1, True)], "k string, v long, is_active boolean")
    new = spark.createDataFrame([("a", 2, True)], base.schema)
    assert {tuple(r) for r in upsert(base, new, ["k"]).collect()} == {("a", 2, True), ("b", 1, True)}
    assert latest(base.unionByName(new), ["k"], ["v"]).filter("k = 'a'").first()["v"] == 2
    assert history(base.unionByName(new), order="v", limit=1).first()["v"] == 2
    assert {tuple(r) for r in activate(base, new).collect()} == {
        ("a", 1, False), ("b", 1, False), ("a", 2, True)}
    assert {tuple(r) for r in activate(base, new, ["k"]).collect()} == {
        ("a", 1, False), ("b", 1, True), ("a", 2, True)}
    assert soft_delete(base, F.col("k") == "a").filter("is_active").count() == 1


def test_fingerprint_ignores_row_order(spark):
    rows = [("m", f"p{i}", "x") for i in range(5)]
    schema = "model_id string, path string, content string"
    one, two = (fingerprint(spark.createDataFrame(r, schema), ["model_id"]).first()["fingerprint"]
                for r in (rows, rows[::-1]))
    other = fingerprint(spark.createDataFrame(rows[:-1] + [("m", "p4", "y")], schema), ["model_id"])
    assert one == two != other.first()["fingerprint"]


def test_model_files(spark, tmp_path):
    (tmp_path / "shop.json").write_text(json.dumps(GOOD, indent=1))
    got = read_models(spark, str(tmp_path)).first()
    assert (got["model_id"], got["version_id"], got["doc"]["metrics"][0]["name"]) == ("shop", "1.0.0", "Total")


def test_quality_of_a_small_ontology(spark):
    ontology = Ontology.from_dict({"entities": [{"name": "A", "properties": [
        {"name": "name", "type": "string", "required": True, "indexed": True}]},
        {"name": "A", "properties": [{"name": "x", "type": "blob"}]}],
        "relations": [{"name": "REL", "source": "A", "target": "Ghost", "directed": False}]})
    got = schema_quality(ontology.tables(spark)).first()
    assert got["issue_count"] == 3
    assert got["completeness"] == pytest.approx(0.15 + 0.15 + 0.2 + 0.1)
    assert got["consistency"] == pytest.approx(1 - 0.2 - 0.05 - 0.02)
    assert got["coherence"] == pytest.approx(0.2 + 0.2 + 0.05)
    assert got["structure"] == pytest.approx(0.15 + 0.15 + 0.2)
    assert got["grade"] == "F" and any(r.startswith("issues:") for r in got["recommendations"])


def test_answers(spark):
    expect = spark.createDataFrame(
        [("q", ["A", "B"], ["sum"], "Total"), ("free", None, None, None)],
        "question string, expected_tables array<string>, expected_sql_patterns array<string>, expected_answer_snippet string")
    answers = spark.createDataFrame([
        (1, "q", True, None, "select SUM(x)", "the total is", ["B", "A"], 1.0),
        (2, "q", True, None, "select 1", "none", ["A"], 2.0), (3, "q", False, "down", None, None, None, 5.0),
        (4, "q", True, None, None, None, ["A", "B"], 3.0), (5, "free", True, None, None, None, None, None)],
        "n int, question string, success boolean, error string, sql string, answer string, tables array<string>, latency_ms double")
    results = evaluate_answers(expect, answers)
    reasons = {r["n"]: r["failure_reason"] for r in results.collect()}
    assert reasons == {1: None, 2: "Missing expected tables: B; Missing SQL patterns: sum; "
                                   "Answer snippet not found: 'Total'",
                       3: "API call failed: down", 4: None, 5: None}
    assert list(regression_summary(results).first()) == [5, 3, 2, False, 6.0]
    partial = evaluate_answers(expect, answers.withColumn("run", F.col("n") > 3), run=["run"])
    silent = partial.filter("failure_reason = 'API call failed: No answer'").collect()
    assert [(r["run"], r["question"]) for r in silent] == [(False, "free")]
    assert not evaluate_answers(expect, answers.filter("n = 1")).filter("question = 'free'").first()["passed"]


def graph_rows(spark, graphs):
    rows = [(i, list(names), [{"u": u, "v": v} for u, v in edges]) for i, (names, edges) in enumerate(graphs)]
    return spark.createDataFrame(rows, "i int, names array<string>, edges array<struct<u: string, v: string>>")


def test_ambiguous_pairs_and_cycles_of_random_graphs(spark):
    rng = random.Random(2)
    graphs = [("abcdefg", [tuple(rng.sample("abcdefg", 2)) for _ in range(rng.randint(0, 9))]) for _ in range(150)]

    def ways(names, edges, longest):
        found = {}

        def walk(start, here, seen):
            for u, v in edges:
                far = v if here == u else u if here == v else None
                if far is not None and far not in seen:
                    if start < far:
                        found[start, far] = found.get((start, far), 0) + 1
                    if len(seen) + 1 < longest:
                        walk(start, far, seen | {far})
        for name in names:
            walk(name, name, {name})
        return {pair: n for pair, n in found.items() if n > 1}
    df = graph_rows(spark, graphs).withColumn("shape", graph_shape(F.col("names"), F.col("edges")))
    for longest in (2, 3, 4, 5, None):
        rows = df.withColumn("pairs", ambiguous_pairs(F.col("names"), F.col("edges"), longest)).collect()
        for r in rows:
            want = ways(*graphs[r.i], longest or 7)
            got = {(p.object1, p.object2): p.n_paths for p in r.pairs}
            assert got == want if longest else got.keys() == want.keys()
            girth = r["shape"].girth
            assert bool(want) == (girth is not None and (longest is None or girth <= 2 * (longest - 1)))


def test_cache_fills_of_one_key_in_many_cells(spark):
    rng = random.Random(6)
    spans = [(1, 4000.0, 3), (1, 90.0, 3), (2, 100_000.0, 3), (1, 50_000.0, 0)]
    for keys, span, digits in spans:
        rows = [(i, rng.choice([None, "a"][-keys:]), round(rng.random() * span - 1000, digits)) for i in range(3000)]
        log = spark.createDataFrame(rows + [(9999, "a", None)], "request_id long, request_key string, s double").select(
            "request_id", "request_key", F.timestamp_micros(F.round(F.col("s") * 1e6).cast("long")).alias("ts"))
        want, due = {9999: None}, {}
        for i, key, second in sorted(rows, key=lambda r: (r[2], r[0])):
            micros = round(second * 1e6)
            want[i] = micros < due.get(key, -2**63)
            if not want[i]:
                due[key] = micros + 100_000_000
        assert {r["request_id"]: r["cached"] for r in label_cache_hits(log, 100).collect()} == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = miss_instants(log, 100).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_cache_hits_at_the_ttl_boundary(spark):
    times = [0, 50, 99, 100, 100, 150, 199, 200, 500]
    log = spark.createDataFrame([(i, "k", t) for i, t in enumerate(times)] + [(99, "other", 60)],
                                "request_id long, request_key string, s long").withColumn(
        "ts", F.timestamp_seconds("s")).drop("s")
    hits = {r["request_id"]: r["cached"] for r in label_cache_hits(log, 100).collect()}
    assert {i for i, hit in hits.items() if not hit} == {0, 3, 7, 8, 99}


def test_usage(spark):
    log = spark.createDataFrame([("gpt-4", 1000000, 0, False), ("odd", 0, 1000000, False),
                                 ("odd", 5, 5, True)],
                                "model string, input_tokens long, output_tokens long, cached boolean")
    stats = {r["model"]: r for r in usage_stats(request_cost(log)).collect()}
    assert stats["gpt-4"]["total_cost"] == 30.0 and stats["odd"]["total_cost"] == 1.5
    assert stats[None]["total_requests"] == 3 and stats[None]["cache_hit_rate"] == pytest.approx(1 / 3)
