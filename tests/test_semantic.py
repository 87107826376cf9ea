import json
import random

import pytest
from pyspark.sql import functions as F

from semgraph.plans.publish import publish, rollback, verify_environments, verify_model
from semgraph.plans.semantic import (SemanticError, SemanticModel, describe_query, format_metric,
                                     object_view, semantic_query, with_tables)

DOC = {
    "name": "shop", "version": "1.0.0",
    "objects": [
        {"name": "Customer", "identifiers": ["id"], "properties": [
            {"name": "id", "type": "string"}, {"name": "city", "type": "string"},
            {"name": "credit", "type": "integer"}]},
        {"name": "Order", "identifiers": ["id"], "properties": [
            {"name": "id", "type": "string"}, {"name": "customer_id", "type": "string"}]},
        {"name": "Item", "properties": [
            {"name": "order_id", "type": "string"}, {"name": "qty", "type": "integer"}]},
    ],
    "relationships": [
        {"name": "placed_by", "from": "Order", "to": "Customer", "joinKeys": [["customer_id", "id"]]},
        {"name": "holds", "from": "Order", "to": "Item", "joinKeys": [["id", "order_id"]],
         "cardinality": "one_to_many"},
    ],
    "metrics": [
        {"name": "Qty", "expression": "SUM(Item.qty)", "grain": ["Order"]},
        {"name": "Orders", "expression": "COUNT(DISTINCT Order.id)", "grain": ["Order"]},
        {"name": "Rows", "expression": "COUNT(Order.id)", "grain": ["Order"]},
        {"name": "Credit", "expression": "Customer.credit", "type": "sum", "grain": ["Customer"]},
    ],
    "dimensions": [{"name": "City", "sourceProperty": "Customer.city"}],
}


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "Customer": spark.createDataFrame([("a", "Rome", 5), ("b", None, 7)],
                                          "id string, city string, credit long"),
        "Order": spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "b"), ("4", "x")],
                                       "id string, customer_id string"),
        "Item": spark.createDataFrame([("1", 2), ("1", 3), ("3", 4)], "order_id string, qty long"),
    }


@pytest.fixture(scope="module")
def bound(spark, tables):
    return SemanticModel.from_dict(DOC).bind(spark, tables)


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_metrics_do_not_multiply_each_other(bound):
    got = rows(semantic_query(bound, ["Qty", "Rows", "Credit"], ["City"]))
    # order 4 has no customer: it shares the NULL city with customer b
    assert got == {("Rome", 5, 2, 5), (None, 4, 2, 7)}


def test_grand_total_keeps_unmatched_rows(bound):
    assert rows(semantic_query(bound, ["Orders", "Qty"])) == {(4, 9)}


def test_fan_trap_is_refused(bound):
    with pytest.raises(SemanticError, match="fan-out"):
        semantic_query(bound, ["Rows"], ["Item.qty"])
    with pytest.raises(SemanticError, match="fan-out"):
        semantic_query(bound, ["Credit"], where="Order.id = '1'")


def test_distinct_count_may_use_a_finer_root(bound):
    assert rows(semantic_query(bound, ["Orders"], where="Item.qty >= 3")) == {(2,)}


def test_two_routes_are_ambiguous(spark, tables):
    doc = {**DOC, "relationships": DOC["relationships"] + [
        {"name": "billed_to", "from": "Order", "to": "Customer", "joinKeys": [["customer_id", "id"]]}]}
    model = SemanticModel.from_dict(doc).bind(spark, tables)
    with pytest.raises(SemanticError, match="ambiguous"):
        semantic_query(model, ["Rows"], ["City"])


def model_of(names, pairs):
    return SemanticModel.from_dict({
        "objects": [{"name": n, "identifiers": ["id"], "properties": [{"name": "id", "type": "string"}]} for n in names],
        "relationships": [{"name": f"r{i}", "from": a, "to": b, "joinKeys": [["id", "id"]], "cardinality": "many_to_one"}
                          for i, (a, b) in enumerate(pairs)],
        "metrics": [{"name": "Rows", "expression": f"COUNT({names[0]}.id)", "type": "custom", "grain": [names[0]]}],
        "dimensions": [{"name": f"D{n}", "sourceProperty": f"{n}.id"} for n in names]})


def all_routes(model, root):
    """Every route without repeated objects, by enumeration."""
    found, steps = {}, model.steps_out()

    def walk(here, route, seen):
        found.setdefault(here, []).append(route)
        for step in steps.get(here, ()):
            if step[2] not in seen:
                walk(step[2], route + (step,), seen | {step[2]})
    walk(root, (), {root})
    return found


def test_routes_agree_with_enumeration_on_random_models():
    rng = random.Random(0)
    several = 0
    for _ in range(5000):
        names = [f"N{i}" for i in range(rng.randint(1, 8))]
        pairs = [(rng.choice(names), rng.choice(names)) for _ in range(rng.randint(0, 2 * len(names)))]
        model = model_of(names, pairs)
        want, got = all_routes(model, "N0"), model.routes_from("N0")
        assert got.keys() == want.keys()
        for name, routes in got.items():
            assert len(routes) == min(2, len(want[name])) and len(set(routes)) == len(routes)
            assert set(routes) <= set(want[name]) and len(routes[0]) == min(map(len, want[name]))
            several += len(routes) > 1
    assert several > 1000


def test_second_route_through_a_cycle_is_refused(spark):
    pairs = ["RY", "YX", "YZ", "ZX", "RW", "WV", "VU", "UX", "XY"]
    model = model_of(list("RYXZWVU"), [tuple(p) for p in pairs])
    assert [len(r) for r in model.routes_from("R")["Y"]] == [1, 5]
    bound = model.bind(spark, {n: spark.createDataFrame([("1",)], "id string") for n in model.objects})
    with pytest.raises(SemanticError, match="R-Y or R-W-V-U-X-Y"):
        semantic_query(bound, ["Rows"], ["DY"])
    assert rows(semantic_query(bound, ["Rows"], ["DV"])) == {("1", 1)}


def test_routes_of_a_large_model_take_no_enumeration():
    names = [f"N{i}" for i in range(400)]
    ladder = [(names[i], names[j]) for i in range(400) for j in (i + 1, i + 2, i - 1) if 0 <= j < 400]
    assert all(len(r) == 2 for n, r in model_of(names, ladder).routes_from("N0").items() if n != "N0")
    assert len(model_of(names, [(names[i], names[i + 1]) for i in range(399)] + [(names[399], names[5])]).routes_from("N0")["N399"]) == 1


def test_one_to_one_joins_inner(spark, tables):
    doc = {**DOC, "relationships": [{**DOC["relationships"][0], "cardinality": "one_to_one"}]}
    model = SemanticModel.from_dict(doc).bind(spark, tables)
    assert rows(semantic_query(model, ["Rows"], ["City"])) == {("Rome", 2), (None, 1)}


def test_grain_filter_top_and_names(bound):
    assert rows(semantic_query(bound, ["Qty"], at_grain=True)) == {("1", 5), ("3", 4)}
    top = semantic_query(bound, ["Rows"], ["City"], order_by="Rows", limit=1).collect()
    assert len(top) == 1 and top[0]["Rows"] == 2
    with pytest.raises(SemanticError):
        semantic_query(bound, ["Nope"])
    with pytest.raises(SemanticError):
        semantic_query(bound, ["Rows"], ["Nope.x"])


def test_filter_and_columns_reach_the_scan(spark, tables, tmp_path):
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / f"{name.lower()}.parquet"))
    model = SemanticModel.from_dict(DOC).bind(spark, base_path=str(tmp_path))
    df = semantic_query(model, ["Rows"], where="Order.customer_id = 'a'")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(customer_id,a)" in plan and "city" not in plan
    assert rows(df) == {(2,)}


def test_format(spark):
    df = spark.createDataFrame([(1234.5,)], "x double")
    got = df.select(format_metric(F.col("x"), "$#,##0.00"), format_metric(F.col("x"), "0.0"),
                    format_metric(F.col("x"), "0%")).first()
    assert list(got) == ["$1,234.50", "1234.5", "123450%"]


def test_views_and_description(spark, bound):
    assert object_view(bound, "Customer").columns == ["city", "credit"]
    about = describe_query(bound, ["Rows"], ["City"]).first()
    assert about["tables"] == ["Order", "Customer"] and "LEFT JOIN Customer" in about["sql"]


def test_publish_and_rollback(spark, tables):
    one = {**DOC, "objects": DOC["objects"][:1], "relationships": [], "metrics": [], "dimensions": []}
    publish(SemanticModel.from_dict(DOC).bind(spark, tables), "shop_view", root="Order")
    assert "Customer_city" in spark.table("shop_view").columns
    schema = "view_name string, version_number long, model_json string"
    history = spark.createDataFrame([("shop_view", 1, json.dumps(one)),
                                     ("shop_view", 2, json.dumps(DOC))], schema)
    assert rollback(spark, history, "shop_view", tables) == "1"
    assert spark.table("shop_view").columns == ["Customer_id", "Customer_city", "Customer_credit"]
    assert rollback(spark, history.filter("version_number = 1"), "shop_view", tables) is None
    assert not spark.catalog.tableExists("shop_view")


def test_verify(spark, tables):
    model = SemanticModel.from_dict(DOC)
    assert verify_model(spark, model, tables).count() == 0
    broken = {**tables, "Item": tables["Item"].drop("qty")}
    found = {(r["element_kind"], r["element_name"]) for r in verify_model(spark, model, broken).collect()}
    assert found == {("property", "Item.qty"), ("metric", "Qty")}
    moved = with_tables(model, {"Customer": "missing_table"})
    partial = {k: v for k, v in tables.items() if k != "Customer"}
    envs = verify_environments(spark, moved, {"dev": {"tables": tables}, "prod": {"tables": partial}})
    by_env = {r["env"]: r["error"] for r in envs.collect()}
    assert by_env["dev"] is None and "NOT_FOUND" in by_env["prod"]
