"""Semantic queries and published views on the retail tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from catalog.base import Catalog
from semgraph.operators.history import latest
from semgraph.plans.publish import publish, rollback
from semgraph.plans.semantic import SemanticModel, describe_query, object_view, semantic_query

CATALOG = Catalog()


def _object(name, table, ident, **props):
    return {"name": name, "identifiers": ident, "mapping": {"table": table},
            "properties": [{"name": k, "type": v} for k, v in props.items()]}


def _rel(name, a, b, key_a, key_b, cardinality="many_to_one"):
    return {"name": name, "from": a, "to": b, "joinKeys": [[key_a, key_b]],
            "cardinality": cardinality}


DISCOUNT = "SUM(Line.l_extendedprice * COALESCE(Line.l_discount, 0))"
RETURNED = "SUM(CASE WHEN Line.l_returnflag = 'R' THEN Line.l_quantity ELSE 0 END)"

RETAIL = {
    "name": "retail", "version": "1.0.0",
    "objects": [
        _object("Customer", "customer", ["c_custkey"], c_custkey="integer", c_name="string",
                c_nationkey="integer", c_acctbal="number", c_mktsegment="string"),
        _object("Order", "orders", ["o_orderkey"], o_orderkey="integer", o_custkey="integer",
                o_orderstatus="string", o_totalprice="number", o_orderdate="timestamp",
                o_orderpriority="string"),
        _object("Line", "lineitem", [], l_orderkey="integer", l_partkey="integer",
                l_suppkey="integer", l_quantity="number", l_extendedprice="number",
                l_discount="number", l_returnflag="string"),
        _object("Part", "part", ["p_partkey"], p_partkey="integer", p_name="string",
                p_brand="string", p_type="string", p_size="integer", p_retailprice="number"),
        _object("Supplier", "supplier", ["s_suppkey"], s_suppkey="integer", s_name="string",
                s_acctbal="number"),
        _object("Nation", "nation", ["n_nationkey"], n_nationkey="integer", n_name="string"),
        _object("Region", "region", ["r_regionkey"], r_regionkey="integer", r_name="string"),
    ],
    "relationships": [
        _rel("line_order", "Line", "Order", "l_orderkey", "o_orderkey"),
        _rel("line_part", "Line", "Part", "l_partkey", "p_partkey"),
        _rel("line_supplier", "Line", "Supplier", "l_suppkey", "s_suppkey"),
        _rel("order_customer", "Order", "Customer", "o_custkey", "c_custkey"),
        _rel("customer_nation", "Customer", "Nation", "c_nationkey", "n_nationkey"),
        _rel("nation_region", "Nation", "Region", "n_regionkey", "r_regionkey"),
    ],
    "metrics": [
        {"name": "DiscountGiven", "expression": DISCOUNT, "grain": ["Order"], "type": "sum",
         "format": "$#,##0.00"},
        {"name": "DiscountToCustomer", "expression": DISCOUNT, "grain": ["Customer"], "type": "sum"},
        {"name": "DiscountOnPart", "expression": DISCOUNT, "grain": ["Part"], "type": "sum"},
        {"name": "UrgentOrders", "grain": ["Order"], "type": "count",
         "expression": "COUNT(DISTINCT CASE WHEN Order.o_orderpriority < '3' THEN Order.o_orderkey END)"},
        {"name": "DiscountPerLine", "grain": ["Order"], "type": "average",
         "expression": f"{DISCOUNT} / COUNT(Line.l_orderkey)", "format": "$#,##0.00"},
        {"name": "ReturnedQuantity", "expression": RETURNED, "grain": ["Line"], "type": "sum"},
        {"name": "OrderTotal", "expression": "SUM(Order.o_totalprice)", "grain": ["Order"], "type": "sum"},
        {"name": "Lines", "expression": "Line.l_orderkey", "grain": ["Line"], "type": "count"},
        {"name": "MeanPrice", "expression": "Line.l_extendedprice", "grain": ["Line"],
         "type": "average"},
        {"name": "LowPrice", "expression": "Line.l_extendedprice", "grain": ["Line"], "type": "min"},
        {"name": "HighPrice", "expression": "Line.l_extendedprice", "grain": ["Line"], "type": "max"},
        {"name": "SuppliersUsed", "expression": "Line.l_suppkey", "grain": ["Line"],
         "type": "distinct_count"},
        {"name": "Accounts", "expression": "SUM(Customer.c_acctbal)", "grain": ["Customer"],
         "type": "sum"},
    ],
    "dimensions": [
        {"name": "Segment", "sourceProperty": "Customer.c_mktsegment"},
        {"name": "Buyer", "sourceProperty": "Customer.c_name"},
        {"name": "Status", "sourceProperty": "Order.o_orderstatus"},
        {"name": "Priority", "sourceProperty": "Order.o_orderpriority"},
        {"name": "PartType", "sourceProperty": "Part.p_type"},
        {"name": "Brand", "sourceProperty": "Part.p_brand"},
        {"name": "HomeNation", "sourceProperty": "Nation.n_name"},
        {"name": "HomeRegion", "sourceProperty": "Region.r_name"},
    ],
}

LABELLED = {
    "name": "labelled", "version": "1.0.0",
    "objects": [_object("Document", "documents", ["doc_id"], doc_id="integer", lang="string",
                        n_chars="integer"),
                _object("Label", "labels", ["doc_id"], doc_id="integer", quality="integer",
                        toxic="integer")],
    "relationships": [_rel("labelled_as", "Document", "Label", "doc_id", "doc_id", "one_to_one")],
    "metrics": [{"name": "Documents", "expression": "Document.doc_id", "grain": ["Document"],
                 "type": "count"},
                {"name": "Characters", "expression": "Document.n_chars", "grain": ["Document"],
                 "type": "sum"}],
    "dimensions": [{"name": "Lang", "sourceProperty": "Document.lang"},
                   {"name": "Quality", "sourceProperty": "Label.quality"}],
}


def retail(spark, sf):
    return SemanticModel.from_dict(RETAIL).bind(spark, base_path=sf)


def rounded(df, *names, digits=4):
    """Money sums have four decimals, so rounding there is free of ties between engines; means
    take six."""
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


SQL_DISCOUNT = "SUM(l_extendedprice * COALESCE(l_discount, 0))"
SQL_RETURNED = "SUM(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END)"
SQL_URGENT = "COUNT(DISTINCT CASE WHEN o_orderpriority < '3' THEN o_orderkey END)"
SQL_LINES = "lineitem LEFT JOIN orders ON l_orderkey = o_orderkey"
SQL_CUST = SQL_LINES + " LEFT JOIN customer ON o_custkey = c_custkey"


@CATALOG.add("semantic_discount_by_segment", f"""
    SELECT c_mktsegment AS Segment, ROUND({SQL_DISCOUNT}, 4) AS DiscountGiven FROM {SQL_CUST} GROUP BY 1""")
def discount_by_segment(spark, sf):
    return rounded(semantic_query(retail(spark, sf), ["DiscountGiven"], ["Segment"]), "DiscountGiven")


@CATALOG.add("semantic_grand_total", f"""
    SELECT a.*, b.* FROM
      (SELECT ROUND({SQL_DISCOUNT}, 4) AS DiscountGiven, {SQL_RETURNED} AS ReturnedQuantity FROM lineitem) a,
      (SELECT {SQL_URGENT} AS UrgentOrders, ROUND(SUM(o_totalprice), 2) AS OrderTotal FROM orders) b""")
def grand_total(spark, sf):
    df = semantic_query(retail(spark, sf),
                        ["DiscountGiven", "ReturnedQuantity", "UrgentOrders", "OrderTotal"])
    return rounded(rounded(df, "DiscountGiven"), "OrderTotal", digits=2)


@CATALOG.add("semantic_all_aggregates", f"""
    SELECT n_name AS HomeNation, r_name AS HomeRegion, COUNT(l_orderkey) AS Lines,
           ROUND(AVG(l_extendedprice), 6) AS MeanPrice, MIN(l_extendedprice) AS LowPrice,
           MAX(l_extendedprice) AS HighPrice, COUNT(DISTINCT l_suppkey) AS SuppliersUsed,
           {SQL_RETURNED} AS ReturnedQuantity
    FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
    LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def all_aggregates(spark, sf):
    df = semantic_query(
        retail(spark, sf),
        ["Lines", "MeanPrice", "LowPrice", "HighPrice", "SuppliersUsed", "ReturnedQuantity"],
        ["HomeNation", "HomeRegion"])
    return rounded(df, "MeanPrice", digits=6)


@CATALOG.add("semantic_discount_per_line", f"""
    SELECT c_mktsegment AS Segment, o_orderstatus AS Status,
           ROUND({SQL_DISCOUNT} / COUNT(l_orderkey), 6) AS DiscountPerLine
    FROM {SQL_CUST} GROUP BY 1, 2""")
def discount_per_line(spark, sf):
    df = semantic_query(retail(spark, sf), ["DiscountPerLine"], ["Segment", "Status"])
    return rounded(df, "DiscountPerLine", digits=6)


@CATALOG.add("semantic_at_order_grain", f"""
    SELECT o_orderkey, ROUND({SQL_DISCOUNT}, 4) AS DiscountGiven FROM {SQL_LINES} GROUP BY 1""")
def at_order_grain(spark, sf):
    return rounded(semantic_query(retail(spark, sf), ["DiscountGiven"], at_grain=True),
                   "DiscountGiven")


@CATALOG.add("semantic_at_customer_grain", f"""
    SELECT r_name AS HomeRegion, c_custkey, ROUND({SQL_DISCOUNT}, 4) AS DiscountToCustomer FROM {SQL_CUST}
    LEFT JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def at_customer_grain(spark, sf):
    df = semantic_query(retail(spark, sf), ["DiscountToCustomer"], ["HomeRegion"], at_grain=True)
    return rounded(df, "DiscountToCustomer")


@CATALOG.add("semantic_at_part_grain", f"""
    SELECT p_partkey, ROUND({SQL_DISCOUNT}, 4) AS DiscountOnPart
    FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def at_part_grain(spark, sf):
    return rounded(semantic_query(retail(spark, sf), ["DiscountOnPart"], at_grain=True),
                   "DiscountOnPart")


@CATALOG.add("semantic_multi_metric", f"""
    WITH i AS (SELECT c_mktsegment AS Segment, ROUND({SQL_DISCOUNT}, 4) AS DiscountGiven,
                      COUNT(DISTINCT l_suppkey) AS SuppliersUsed FROM {SQL_CUST} GROUP BY 1),
         o AS (SELECT c_mktsegment AS Segment, {SQL_URGENT} AS UrgentOrders
               FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1),
         c AS (SELECT c_mktsegment AS Segment, ROUND(SUM(c_acctbal), 4) AS Accounts
               FROM customer GROUP BY 1)
    SELECT COALESCE(i.Segment, o.Segment, c.Segment) AS Segment, DiscountGiven, UrgentOrders,
           SuppliersUsed, Accounts
    FROM i FULL JOIN o ON i.Segment IS NOT DISTINCT FROM o.Segment
    FULL JOIN c ON c.Segment IS NOT DISTINCT FROM COALESCE(i.Segment, o.Segment)""")
def multi_metric(spark, sf):
    df = semantic_query(retail(spark, sf),
                        ["DiscountGiven", "UrgentOrders", "SuppliersUsed", "Accounts"], ["Segment"])
    return rounded(df, "DiscountGiven", "Accounts")


@CATALOG.add("semantic_filtered", f"""
    SELECT p_brand AS Brand, ROUND({SQL_DISCOUNT}, 4) AS DiscountGiven, {SQL_RETURNED} AS ReturnedQuantity
    FROM {SQL_CUST} LEFT JOIN part ON l_partkey = p_partkey
    WHERE c_mktsegment = 'MACHINERY' AND l_quantity >= 10 AND o_orderdate >= TIMESTAMP '1997-01-01'
    GROUP BY 1""")
def filtered(spark, sf):
    df = semantic_query(
        retail(spark, sf), ["DiscountGiven", "ReturnedQuantity"], ["Brand"],
        where="Customer.c_mktsegment = 'MACHINERY' AND Line.l_quantity >= 10 "
              "AND Order.o_orderdate >= TIMESTAMP '1997-01-01'")
    return rounded(df, "DiscountGiven")


@CATALOG.add("semantic_count_across_lines", f"""
    SELECT p_type AS PartType, {SQL_URGENT} AS UrgentOrders
    FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
    LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def count_across_lines(spark, sf):
    return semantic_query(retail(spark, sf), ["UrgentOrders"], ["PartType"])


@CATALOG.add("semantic_top_customers", f"""
    SELECT c_name AS Buyer, ROUND({SQL_DISCOUNT}, 4) AS DiscountGiven FROM {SQL_CUST}
    GROUP BY 1 ORDER BY {SQL_DISCOUNT} DESC, 1 LIMIT 10""")
def top_customers(spark, sf):
    df = semantic_query(retail(spark, sf), ["DiscountGiven"], ["Buyer"],
                        order_by="DiscountGiven", limit=10)
    return rounded(df, "DiscountGiven")


@CATALOG.add("semantic_formatted", f"""
    SELECT o_orderpriority AS Priority,
           '$' || format('{{:,.2f}}', {SQL_DISCOUNT}) AS DiscountGiven,
           '$' || format('{{:,.2f}}', {SQL_DISCOUNT} / COUNT(l_orderkey)) AS DiscountPerLine
    FROM {SQL_LINES} GROUP BY 1""")
def formatted(spark, sf):
    return semantic_query(retail(spark, sf), ["DiscountGiven", "DiscountPerLine"],
                          ["Priority"], formatted=True)


@CATALOG.add("semantic_one_to_one", """
    SELECT lang AS Lang, quality AS Quality, COUNT(d.doc_id) AS Documents,
           CAST(SUM(n_chars) AS BIGINT) AS Characters
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1, 2""")
def one_to_one(spark, sf):
    bound = SemanticModel.from_dict(LABELLED).bind(spark, base_path=sf)
    return semantic_query(bound, ["Documents", "Characters"], ["Lang", "Quality"])


@CATALOG.add("semantic_object_view", """
    SELECT c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment
    FROM customer""")
def customer_view(spark, sf):
    return object_view(retail(spark, sf), "Customer").select(
        "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@CATALOG.add("semantic_described_tables", f"""
    SELECT 'DiscountGiven' AS metric, 'Line,Order,Customer' AS tables, 'line_order,order_customer'
           AS relationships, COUNT(*) AS n_rows FROM {SQL_CUST}""")
def described_tables(spark, sf):
    """Description of a query next to the size of its join."""
    bound = retail(spark, sf)
    about = describe_query(bound, ["DiscountGiven"], ["Segment"])
    model = bound.model
    size = bound.joined(model.join_tree(model.metrics["DiscountGiven"], {"Customer"})).agg(
        F.count("*").alias("n_rows"))
    return about.select(
        F.array_join("metrics", ",").alias("metric"), F.array_join("tables", ",").alias("tables"),
        F.array_join("relationships", ",").alias("relationships"), size.scalar().alias("n_rows"))


VIEW_SQL = """
    SELECT r_name AS region, COUNT(*) AS n_rows, COUNT(DISTINCT c_custkey) AS customers,
           SUM(l_quantity) AS quantity
    FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
    LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN part ON l_partkey = p_partkey
    LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1"""


@CATALOG.add("published_view", VIEW_SQL)
def published_view(spark, sf):
    publish(retail(spark, sf), "retail_view")
    return spark.sql("""SELECT Region_r_name AS region, COUNT(*) AS n_rows,
        COUNT(DISTINCT Customer_c_custkey) AS customers, SUM(Line_l_quantity) AS quantity
        FROM retail_view GROUP BY 1""")


@CATALOG.add("rolled_back_view", """
    SELECT o_orderpriority AS priority, COUNT(*) AS n_rows FROM orders GROUP BY 1""")
def rolled_back_view(spark, sf):
    """Publish two versions, go back to the first: the view shows orders alone again."""
    first = {**RETAIL, "version": "1.0.0", "relationships": [],
             "objects": [o for o in RETAIL["objects"] if o["name"] == "Order"]}
    second = {**RETAIL, "version": "2.0.0"}
    versions = spark.createDataFrame(
        [("orders_view", 1, json.dumps(first)), ("orders_view", 2, json.dumps(second))],
        "view_name string, version_number long, model_json string")
    newest = latest(versions, ["view_name"], ["version_number"]).first()
    publish(SemanticModel.from_json(newest["model_json"]).bind(spark, base_path=sf), "orders_view")
    rollback(spark, versions, "orders_view", base_path=sf)
    return spark.sql("SELECT Order_o_orderpriority AS priority, COUNT(*) AS n_rows "
                     "FROM orders_view GROUP BY 1")


