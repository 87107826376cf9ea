import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from semgraph.functions.text import chunk_bounds, chunk_text, document_mentions, normalize_text
from semgraph.functions.values import map_last_wins
from semgraph.operators.extract import (entity_id_col, entity_type_col, extract,
                                        extract_with, fk_relations, infer_entity_types,
                                        map_properties, nested_relations,
                                        suggest_entity_type)
from semgraph.operators.validate import (split_valid, unique_violations, validate_entities,
                                         validate_relations, validate_rows)
from semgraph.sources.ontology import Ontology, read_ontology
from semgraph.sources.records import read_expectations

ONTOLOGY = Ontology.from_dict({
    "entities": [{"name": "Person", "properties": [
        {"name": "name", "type": "string", "required": True}, {"name": "age", "type": "integer"},
        {"name": "email", "type": "string"}]},
        {"name": "Firm", "properties": [{"name": "name", "type": "string", "required": True}]}],
    "relations": [{"name": "WORKS_FOR", "source": "Person", "target": "Firm"},
                  {"name": "RELATED_TO", "source": "*", "target": "*"}],
    "constraints": [{"type": "unique", "entity": "Person", "property": "email"},
                    {"type": "range", "entity": "Person", "property": "age", "min": 0, "max": 150},
                    {"type": "pattern", "entity": "Person", "property": "email", "pattern": "[a-z]+@"}],
})


def test_falsy_values_do_not_count(spark):
    df = spark.createDataFrame([(0, "", None), (5, "0", "x")], "customer_id long, task string, n string")
    rules = {"entity_type_mapping": infer_entity_types(df.columns)}
    kinds = [r[0] for r in df.select(entity_type_col(df, rules)).collect()]
    assert kinds == ["Customer", "Customer"]  # row 1 by keyword of the column names
    rel = fk_relations(df).collect()
    assert [(r["type"], r["target_id"]) for r in rel] == [("HAS_CUSTOMER", "Customer:5")]


def test_id_variants(spark):
    df = spark.createDataFrame([("7", None, "n"), (None, "e", None)], "id string, email string, name string")
    kind = F.lit("K")
    got = {v: [r[0] for r in df.select(entity_id_col(df, kind, v)).collect()]
           for v in ("graph", "fallback", "template")}
    assert got == {"graph": ["K:7", "K:e"], "fallback": ["7", "K:e"], "template": ["K:7", "K:e"]}
    blank = spark.createDataFrame([(None, "v")], "a string, b string")
    assert blank.select(entity_id_col(blank, kind)).first()[0] == "K:a_None"
    assert len(blank.select(entity_id_col(blank, kind, "graph")).first()[0]) == len("K:") + 32


def test_fk_names(spark):
    df = spark.createDataFrame([("1", "2", "3")], "user_id string, orderId string, boss_ref string")
    rel = {r["type"]: r["target_id"] for r in fk_relations(df).collect()}
    assert rel == {"HAS_USER": "User:1", "HAS_ORDER": "Order:2", "HAS_BOSSREF": "Boss:3"}
    loose = {r["type"]: r["target_id"] for r in fk_relations(df, "fallback").collect()}
    assert loose == {"HAS_USERID": "User:1", "HAS_ORDERID": "Order:2"}


def test_fallback_keeps_missing_suffixed_keys(spark):
    df = spark.createDataFrame([("n", None)], "name string, user_id string")
    assert fk_relations(df, "fallback").first()["target_id"] == "User:None"


def test_nested_relations_of_maps(spark):
    df = spark.createDataFrame([([{"source": "a", "target_id": "b", "w": "1"}],)],
                               "relations array<map<string,string>>")
    got = nested_relations(df).first()
    assert (got["type"], got["source_id"], got["target_id"]) == ("RELATED_TO", "a", "b")
    assert got["props"] == {"w": "1"}


def test_extract_drops_reserved_keys(spark):
    df = spark.createDataFrame([("1", "s", "v", "ws")], "id string, source string, b string, w string")
    entities, _rel = extract(df, {"entity_type_mapping": {"id": "T"}}, keep=("w",))
    got = entities.first()
    assert (got["id"], got["props"], got["w"]) == ("T:1", {"b": "v"}, "ws")


def test_user_function(spark):
    def rule(row, rules):
        if row["n"] is None:
            return {}["empty"]
        if row["n"] == 2:
            return 1
        return [{"id": str(row["n"]), "properties": {"k": rules["k"]}}], [{"source": "a", "target": "b"}]

    big = 9007199254740993
    df = spark.createDataFrame([(big,), (2,), (None,)], "n long")
    found = extract_with(df, rule, {"k": 3})
    assert [(r["id"], r["props"]) for r in found.entities.collect()] == [(str(big), {"k": "3"})]
    assert found.relations.first()["type"] == "RELATED_TO"
    assert [r["error"].split(":")[0] for r in found.errors.collect()] in (["TypeError", "KeyError"], ["KeyError", "TypeError"])


def test_property_names_follow_the_ontology(spark):
    df = spark.createDataFrame([("Person", {"NAME": "x", "other": "y"}), ("Else", {"NAME": "z"})],
                               "type string, props map<string,string>")
    got = [r["props"] for r in map_properties(df, ONTOLOGY).collect()]
    assert got == [{"name": "x", "other": "y"}, {"NAME": "z"}]
    both = spark.createDataFrame([([("a", "1"), ("b", "2"), ("a", "3")],)],
                                 "e array<struct<key:string,value:string>>")
    assert both.select(map_last_wins(F.col("e"))).first()[0] == {"b": "2", "a": "3"}


def test_suggested_type(spark):
    df = spark.createDataFrame([(["name"],), (["name", "age"],), (["zip"],)], "k array<string>")
    assert [r[0] for r in df.select(suggest_entity_type(F.col("k"), ONTOLOGY)).collect()] == [
        "Person", "Person", None]


def test_validation(spark):
    df = spark.createDataFrame([
        ("Person", {"name": "a", "age": "10"}), ("Person", {"age": "x"}),
        ("Person", {"name": "b", "age": "200", "email": "9@"}), ("Other", {})],
        "type string, props map<string,string>")
    checked = validate_entities(df, ONTOLOGY)
    errors = [r["errors"] for r in checked.collect()]
    assert errors == [
        [], ["Missing required property: name",
             "Property age has wrong type. Expected integer, got str"],
        ["Value 200 above maximum 150", "Value 9@ does not match pattern [a-z]+@"], []]
    valid, rest = split_valid(checked)
    assert (valid.count(), rest.count()) == (2, 2)
    assert validate_entities(df, ONTOLOGY, strict=True).filter("NOT is_valid").count() == 3


def test_typed_rows(spark):
    df = spark.createDataFrame([("a", 1.5, True)], "name string, age double, email boolean")
    errors = validate_rows(df, "Person", ONTOLOGY).first()["errors"]
    assert errors == ["Property age has wrong type. Expected integer, got float",
                      "Property email has wrong type. Expected string, got bool"]


def test_relations_and_uniqueness(spark):
    rel = spark.createDataFrame([
        Row(type="WORKS_FOR", source_type="Person", target_type="Firm"),
        Row(type="WORKS_FOR", source_type="Firm", target_type="Ghost"),
        Row(type="RELATED_TO", source_type="Ghost", target_type="Firm"),
        Row(type="NEW", source_type="x", target_type="y")]).withColumn(
        "props", F.expr("map('a','b')"))
    sizes = [len(r["errors"]) for r in validate_relations(rel, ONTOLOGY).collect()]
    assert sizes == [0, 2, 1, 0]
    people = spark.createDataFrame([("Person", {"email": "q"}), ("Person", {"email": "q"}),
                                    ("Firm", {"email": "q"})], "type string, props map<string,string>")
    assert [tuple(r) for r in unique_violations(people, ONTOLOGY).collect()] == [
        ("Person", "email", "q", 2)]


def test_chunks():
    text = "One two. " * 40
    bounds = chunk_bounds(text, 100, 20)
    assert all(b - a <= 100 for a, b in bounds) and text[bounds[0][0]:bounds[0][1]].endswith(". ")
    assert bounds[-1][1] == len(text) and all(c == b - 20 for (_, b), (c, _) in zip(bounds, bounds[1:]))
    assert chunk_bounds("short", 100, 20) == [(0, 5)]
    # a sentence end inside the overlap makes no small chunks
    bounds = chunk_bounds("Short intro. " + "x" * 3000, 1000, 200)
    assert len(bounds) == 4 and all(b - a == 1000 for a, b in bounds[:-1])


def test_text_columns(spark):
    df = spark.createDataFrame([(1, " a  b\n\tc "), (2, None)], "id int, t string")
    assert [r[0] for r in df.select(normalize_text(F.col("t"), 3)).collect()] == ["a b...", None]
    chunked = chunk_text(spark.createDataFrame([(1, "x. " * 900)], "id int, t string"), "t").collect()
    assert [r["chunk_index"] for r in chunked] == list(range(chunked[0]["total_chunks"]))
    docs = spark.createDataFrame([("Document:1", "s", "c"), ("", "s", "c"), (None, None, "c")],
                                 "id string, source string, content string")
    assert [r["source_id"] for r in document_mentions(docs).collect()] == [
        "Document:1", "Document:s", "Document:unknown"]


def test_definition_files(spark, tmp_path):
    (tmp_path / "o.yaml").write_text("entities:\n  - name: A\n    properties:\n      - {name: x, type: string}\n")
    assert read_ontology(spark, str(tmp_path / "o.yaml")).property_names() == {"A": ["x"]}
    (tmp_path / "q.yaml").write_text("questions:\n  - question: q\n    expected_tables: [T]\n")
    assert read_expectations(spark, str(tmp_path / "q.yaml")).first()["expected_tables"] == ["T"]
