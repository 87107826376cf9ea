"""Sources and sinks: tables written in a file format and read back as records, file listings,
graph tables and the whole ingest."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.base import Catalog, read
from catalog.extraction import ONTOLOGY, customer_entities
from semgraph.operators.validate import validate_entities
from semgraph.plans.ingest import build_graph, ingest
from semgraph.session import scratch_dir
from semgraph.sources.graph_commits import compact, read_commits, remove_entities
from semgraph.sources.graph_tables import read_graph, write_graph
from semgraph.sources.models import explode_model, read_models
from semgraph.sources.records import preview_files, read_records

CATALOG = Catalog()


def fresh(spark, name):
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


@CATALOG.add("records_csv", """
    SELECT c_mktsegment, COUNT(*) AS n, COUNT(DISTINCT c_name) AS names,
           ROUND(SUM(c_acctbal), 2) AS balance, TRUE AS sourced FROM customer GROUP BY 1""")
def csv_records(spark, sf):
    path = fresh(spark, "csv")
    read(spark, sf, "customer").write.option("header", True).csv(path)
    rows = read_records(spark, path, "csv")
    return rows.groupBy("c_mktsegment").agg(
        F.count("*").alias("n"), F.count_distinct("c_name").alias("names"),
        F.round(F.sum(F.col("c_acctbal").cast("double")), 2).alias("balance"),
        F.bool_and(F.col("source").contains(".csv")).alias("sourced"))


@CATALOG.add("records_json", """
    SELECT event_type, COUNT(*) AS n, ROUND(SUM(value), 2) AS total FROM events GROUP BY 1""")
def json_records(spark, sf):
    path = fresh(spark, "json")
    read(spark, sf, "events").write.json(path)
    rows = read_records(spark, path, "json")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"),
                                          F.round(F.sum("value"), 2).alias("total"))


@CATALOG.add("records_xml", """
    SELECT p_type, COUNT(*) AS n, CAST(SUM(p_size) AS BIGINT) AS size FROM part GROUP BY 1""")
def xml_records(spark, sf):
    path = fresh(spark, "xml")
    read(spark, sf, "part").write.option("rowTag", "row").xml(path)
    rows = read_records(spark, path, "xml", schema="p_type string, p_size long")
    return rows.groupBy("p_type").agg(F.count("*").alias("n"), F.sum("p_size").alias("size"))


@CATALOG.add("records_text", """
    SELECT p_name AS line, COUNT(*) AS n FROM part GROUP BY 1""")
def text_records(spark, sf):
    """Part names as lines of text files."""
    path = fresh(spark, "text")
    read(spark, sf, "part").select(F.col("p_name").alias("value")).write.text(path)
    rows = read_records(spark, path, "text").withColumnRenamed("content", "line")
    return rows.filter("line <> ''").groupBy("line").agg(F.count("*").alias("n"))


@CATALOG.add("records_mixed", """
    SELECT 'csv' AS kind, COUNT(*) AS n, CAST(SUM(c_custkey) AS BIGINT) AS keys FROM customer
    UNION ALL SELECT 'json', COUNT(*), SUM(o_orderkey)::BIGINT FROM orders
    UNION ALL SELECT 'txt', COUNT(*), NULL FROM part""")
def mixed_records(spark, sf):
    """One folder with files of three formats comes back whole."""
    path = fresh(spark, "mixed")
    read(spark, sf, "customer").select("c_custkey").write.option("header", True).csv(f"{path}/a")
    read(spark, sf, "orders").select("o_orderkey").write.json(f"{path}/b")
    read(spark, sf, "part").select(F.col("p_name").alias("value")).write.text(f"{path}/c")
    rows = read_records(spark, path)
    return rows.groupBy(F.regexp_extract("source", r"\.([a-z]+)$", 1).alias("kind")).agg(
        F.count("*").alias("n"), F.sum(F.coalesce(F.col("c_custkey").cast("long"), F.col("o_orderkey"))).alias("keys"))


@CATALOG.add("files_preview", """
    SELECT o_orderpriority AS priority, least(50, COUNT(*)) AS n_lines, TRUE AS known, TRUE AS gapless
    FROM orders GROUP BY 1""")
def preview(spark, sf):
    """The first fifty lines of files with the orders of each priority; every one is a line of the table."""
    path = fresh(spark, "lines")
    orders = read(spark, sf, "orders").select("o_orderpriority", F.concat_ws(
        ",", F.col("o_orderkey").cast("string"), "o_orderpriority").alias("value"))
    orders.repartition("o_orderpriority").write.partitionBy("o_orderpriority").text(path)
    lines = preview_files(spark, path)
    known = orders.select(F.col("value").alias("line"), F.lit(True).alias("known"))
    return lines.join(known, "line", "left").groupBy(
        F.regexp_extract("line", ",(.*)$", 1).alias("priority")).agg(
        F.max("line_number").alias("n_lines"), F.bool_and(F.coalesce("known", F.lit(False))).alias("known"),
        (F.max("line_number") == F.count("*")).alias("gapless"))


@CATALOG.add("files_models", """
    SELECT s_suppkey::VARCHAR AS model_id, s_name AS name, 2 AS n_objects FROM supplier""")
def model_files(spark, sf):
    """A model file per supplier."""
    path = fresh(spark, "models")
    objects = F.array(
        F.struct(F.lit("Supplier").alias("name")),
        F.struct(F.concat(F.lit("Nation"), F.col("s_nationkey").cast("string")).alias("name")))
    doc = F.struct(F.lit("1.0.0").alias("version"), F.col("s_name").alias("name"),
                   objects.alias("objects"))
    # every task writes and commits its own files
    read(spark, sf, "supplier").select("s_suppkey", F.to_json(doc).alias("value")).repartition("s_suppkey") \
        .write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("s_suppkey").text(path)
    reg = explode_model(read_models(spark, path, "*.txt", "s_suppkey=([^/]+)/"))
    counts = reg.objects.groupBy("model_id").agg(F.count("*").alias("n_objects"))
    return reg.models.select("model_id", "name").join(counts, "model_id")


@CATALOG.add("graph_tables", """
    WITH c AS (SELECT CASE WHEN c_acctbal >= 0 AND c_acctbal <= 9000 AND c_nationkey <> 3 AND c_nationkey <> 5
               AND regexp_matches(c_mktsegment, '^[A-M]') AND c_mktsegment <> 'FURNITURE'
             THEN 'good' ELSE 'other' END AS workspace_id FROM customer)
    SELECT workspace_id, 'entity' AS kind, COUNT(*) AS n FROM c GROUP BY 1
    UNION ALL SELECT workspace_id, 'relation', COUNT(*) FROM c GROUP BY 1""")
def tables(spark, sf):
    """Validated customers written to workspaces by verdict, read back with their counts."""
    checked = validate_entities(customer_entities(spark, sf), ONTOLOGY, strict=True)
    entities = checked.select(
        F.when(F.col("is_valid"), "good").otherwise("other").alias("workspace_id"), "id", "type",
        "props", F.lit(0).cast("long").alias("seq"))
    relations = entities.select(
        "workspace_id", F.col("id").alias("source_id"), F.lit("Root:1").alias("target_id"),
        F.lit("IN").alias("type"))
    path = fresh(spark, "graph")
    write_graph(entities, relations, path, files_per_workspace=4)
    kinds = [df.select("workspace_id", F.lit(kind).alias("kind")) for kind, df in
             zip(("entity", "relation"), read_graph(spark, path))]
    return kinds[0].unionByName(kinds[1]).groupBy("workspace_id", "kind").agg(F.count("*").alias("n"))


def order_records(spark, sf):
    return read(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"),
        F.col("o_orderkey").alias("number"))


@CATALOG.add("ingest_counts", """
    SELECT 'stats' AS part, COUNT(*) AS entities, COUNT(*) AS relations FROM orders
    UNION ALL SELECT 'tables', COUNT(*), COUNT(*) FROM orders""")
def ingested(spark, sf):
    path = fresh(spark, "ingest")
    stats = ingest(order_records(spark, sf), "retail", "number", path, ONTOLOGY,
                   {"entity_type_mapping": {"id": "Order"}})
    entities, relations = read_commits(spark, path)
    counts = entities.select(F.lit(1).alias("e"), F.lit(0).alias("r")).unionByName(
        relations.select(F.lit(0).alias("e"), F.lit(1).alias("r"))).agg(
        F.sum("e").alias("entities"), F.sum("r").alias("relations"))
    return stats.select(F.lit("stats").alias("part"), F.col("entities_added").alias("entities"),
                        F.col("relations_added").alias("relations")).unionByName(
        counts.select(F.lit("tables").alias("part"), "entities", "relations"))


@CATALOG.add("ingest_twice", """
    SELECT 'entity' AS kind, 'Order:' || o_orderkey AS a, NULL AS b, o_orderstatus AS status FROM orders
    UNION ALL SELECT 'relation', 'Order:' || o_orderkey, 'Customer:' || o_custkey, NULL FROM orders""")
def ingested_twice(spark, sf):
    """Two overlapping thirds and then the same again make the graph of one ingest of all."""
    path, rows = fresh(spark, "twice"), order_records(spark, sf)
    for part in (rows.filter("number % 3 <> 0"), rows.filter("number % 3 <> 1"), rows.filter("number % 3 <> 1")):
        ingest(part, "retail", "number", path, ONTOLOGY, {"entity_type_mapping": {"id": "Order"}})
    return listed(*read_commits(spark, path))


def listed(entities, relations):
    none = F.lit(None).cast("string")
    return entities.select(F.lit("entity").alias("kind"), F.col("id").alias("a"), none.alias("b"),
                           F.element_at("props", "status").alias("status")).unionByName(
        relations.select(F.lit("relation").alias("kind"), F.col("source_id").alias("a"),
                         F.col("target_id").alias("b"), none.alias("status")))


@CATALOG.add("ingest_commits", """
    WITH o AS (SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0))
    SELECT 'entity' AS kind, 'Order:' || o_orderkey AS a, NULL AS b, o_orderstatus AS status FROM o
    UNION ALL SELECT 'relation', 'Order:' || o_orderkey, 'Customer:' || o_custkey, NULL FROM o""")
def committed(spark, sf):
    """Half of the orders come with an old status, then all as they are; the orders of customers in debt go;
    then the commits become one."""
    path, rows = fresh(spark, "commits"), order_records(spark, sf)
    stale = rows.filter("number % 2 = 0").withColumn("status", F.concat(F.lit("was "), "status"))
    for part in (stale, rows):
        ingest(part, "retail", "number", path, ONTOLOGY, {"entity_type_mapping": {"id": "Order"}})
    debtors = read(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").cast("string").alias("customer_id"))
    remove_entities(spark, path, rows.join(debtors, "customer_id", "left_semi").select(
        F.lit("retail").alias("workspace_id"), F.concat(F.lit("Order:"), "id").alias("id")))
    compact(spark, path)
    return listed(*read_commits(spark, path))


@CATALOG.add("ingest_strict", """
    SELECT 'entities' AS part, COUNT(*) AS n FROM customer WHERE c_acctbal BETWEEN 0 AND 9000
    UNION ALL SELECT 'rejected_entities', COUNT(*) FROM customer WHERE NOT c_acctbal BETWEEN 0 AND 9000
    UNION ALL SELECT 'relations', COUNT(*) FROM customer""")
def strict_ingest(spark, sf):
    rows = read(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("Name"),
        F.col("c_acctbal").alias("Balance"), F.col("c_nationkey").cast("string").alias("home_id"),
        F.col("c_custkey").alias("number"))
    graph = build_graph(rows, "retail", "number", ONTOLOGY,
                        {"entity_type_mapping": {"id": "Customer"}}, strict=True)
    parts = [graph[p].select(F.lit(p).alias("part")) for p in
             ("entities", "rejected_entities", "relations")]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.groupBy("part").agg(F.count("*").alias("n"))
