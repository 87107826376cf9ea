"""Extraction and validation of entities and relations from the tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from catalog.base import Catalog, props_text, read
from semgraph.operators.extract import (default_rules, entity_id_col, entity_type_col, extract,
                                        extract_with, fk_relations, infer_entity_types,
                                        map_properties, nested_relations, project_properties,
                                        suggest_entity_type)
from semgraph.operators.validate import (split_valid, unique_violations, validate_entities,
                                         validate_relations, validate_rows)
from semgraph.sources.ontology import Ontology

CATALOG = Catalog()

ONTOLOGY = Ontology.from_dict({
    "entities": [
        {"name": "Customer", "description": "A buyer", "properties": [
            {"name": "name", "type": "string", "required": True, "indexed": True},
            {"name": "balance", "type": "float", "required": True},
            {"name": "nation", "type": "integer"},
            {"name": "segment", "type": "string"}]},
        {"name": "Product", "properties": [
            {"name": "name", "type": "string", "required": True},
            {"name": "brand", "type": "string"},
            {"name": "size", "type": "integer"},
            {"name": "price", "type": "float"}]},
        {"name": "Review", "properties": [
            {"name": "lang", "type": "string"}, {"name": "quality", "type": "integer"},
            {"name": "toxic", "type": "integer"}]},
        {"name": "Document", "properties": [
            {"name": "lang", "type": "string"}, {"name": "source", "type": "string"},
            {"name": "text", "type": "text"}]},
    ],
    "relations": [
        {"name": "HAS_USER", "source": ["User", "Customer"], "target": "User"},
        {"name": "HAS_NATION", "source": "Customer", "target": "*", "properties": [
            {"name": "since", "type": "date", "required": True},
            {"name": "weight", "type": "integer"}]},
    ],
    "constraints": [
        {"type": "range", "entity": "Customer", "property": "balance", "min": 0, "max": 9000},
        {"type": "pattern", "entity": "Customer", "property": "segment", "pattern": "[A-M]"},
        {"type": "range", "entity": "Product", "property": "size", "min": 5, "max": 45},
        {"type": "unique", "entity": "Product", "property": "name"},
        {"type": "unique", "entity": "Customer", "property": "name"},
    ],
})


@CATALOG.add("extract_entity_types", """
    SELECT CASE WHEN user_id <> 0 THEN 'User' ELSE 'Entity' END AS type, COUNT(*) AS n
    FROM events GROUP BY 1""")
def entity_types(spark, sf):
    events = read(spark, sf, "events")
    rules = {"entity_type_mapping": infer_entity_types(events.columns)}
    return events.groupBy(entity_type_col(events, rules).alias("type")).agg(
        F.count("*").alias("n"))


@CATALOG.add("extract_suggested_types", """
    SELECT CASE WHEN l.doc_id IS NOT NULL THEN 'Review' ELSE 'Document' END AS type,
           COUNT(*) AS n
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""")
def suggested_types(spark, sf):
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    ragged = docs.select("doc_id", "lang", "source", "text").join(labels, "doc_id", "left")
    keys = F.map_keys(F.map_filter(F.create_map(*[
        x for c in ("lang", "source", "quality", "toxic")
        for x in (F.lit(c), F.col(c).cast("string"))]), lambda _k, v: v.isNotNull()))
    return ragged.groupBy(suggest_entity_type(keys, ONTOLOGY).alias("type")).agg(
        F.count("*").alias("n"))


@CATALOG.add("extract_entity_ids", """
    SELECT event_id, 'Event:' || md5('event_id=' || event_id || chr(30) || 'event_type=' ||
               event_type || chr(30) || 'user_id=' || user_id) AS graph_id,
           'Event:event_id_' || event_id AS fallback_id, 'Event:event_id_' || event_id AS template_id,
           'Event:' || event_type AS typed_id
    FROM events""")
def entity_ids(spark, sf):
    events = read(spark, sf, "events").select("event_id", "event_type", "user_id")
    kind = F.lit("Event")
    return events.select(
        "event_id", entity_id_col(events, kind, "graph").alias("graph_id"),
        entity_id_col(events, kind, "fallback").alias("fallback_id"),
        entity_id_col(events, kind, "template").alias("template_id"),
        entity_id_col(events, kind, "template", ["event_type"]).alias("typed_id"))


@CATALOG.add("extract_entity_ids_by_key", """
    SELECT c_custkey::VARCHAR AS id, 'Customer:' || c_custkey AS graph_id,
           c_custkey::VARCHAR AS fallback_id, 'Customer:' || c_custkey AS template_id
    FROM customer""")
def entity_ids_by_key(spark, sf):
    rows = read(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"),
                                              F.col("c_name").alias("name"))
    kind = F.lit("Customer")
    return rows.select("id", *[entity_id_col(rows, kind, v).alias(f"{v}_id")
                               for v in ("graph", "fallback", "template")])


@CATALOG.add("extract_properties", """
    SELECT p_partkey AS key, 'brand=' || p_brand || '|label=' || p_name || '|p_partkey=' ||
           p_partkey || '|size=' || p_size AS props FROM part""")
def properties(spark, sf):
    parts = read(spark, sf, "part").select(
        "p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("brand"),
        F.col("p_size").alias("size"), F.col("p_type").alias("type"))
    props = project_properties(parts, {"name": "label"})
    return parts.select(F.col("p_partkey").alias("key"), props.alias("props")).select(
        "key", props_text().alias("props"))


@CATALOG.add("extract_mapped_properties", """
    SELECT 'Customer:' || c_custkey AS id, 'Extra=' || c_acctbal || '|name=' || c_name ||
           '|segment=' || c_mktsegment AS props FROM customer""")
def mapped_properties(spark, sf):
    rows = read(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("NAME"),
        F.col("c_mktsegment").alias("Segment"), F.col("c_acctbal").alias("Extra"))
    entities = rows.select(F.lit("Customer").alias("type"),
                           F.concat(F.lit("Customer:"), "id").alias("id"),
                           project_properties(rows).alias("props"))
    return map_properties(entities, ONTOLOGY).select("id", props_text().alias("props"))


@CATALOG.add("extract_fk_relations", """
    SELECT type, source_id, target_id, source_type, target_type, COUNT(*) AS n FROM (
      SELECT 'HAS_EVENT' AS type, k || ':event_id_' || event_id AS source_id,
             'Event:' || event_id AS target_id, k AS source_type, 'Event' AS target_type
      FROM (SELECT *, CASE WHEN user_id <> 0 THEN 'User' ELSE 'Entity' END AS k FROM events)
      WHERE event_id <> 0
      UNION ALL
      SELECT 'HAS_USER', k || ':event_id_' || event_id, 'User:' || user_id, k, 'User'
      FROM (SELECT *, CASE WHEN user_id <> 0 THEN 'User' ELSE 'Entity' END AS k FROM events)
      WHERE user_id <> 0) GROUP BY ALL""")
def fk_pattern_relations(spark, sf):
    rel = fk_relations(read(spark, sf, "events"))
    return rel.groupBy("type", "source_id", "target_id", "source_type", "target_type").agg(
        F.count("*").alias("n"))


@CATALOG.add("extract_fk_relations_fallback", """
    SELECT type, target_id, COUNT(*) AS n, COUNT(DISTINCT source_id) AS sources FROM (
      SELECT 'HAS_EVENTID' AS type, 'Entity:event_id_' || event_id AS source_id,
             'Event:' || event_id AS target_id FROM events
      UNION ALL SELECT 'HAS_USERID', 'Entity:event_id_' || event_id, 'User:' || user_id FROM events)
    GROUP BY 1, 2""")
def fk_fallback_relations(spark, sf):
    events = read(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    return fk_relations(events, variant="fallback").groupBy("type", "target_id").agg(
        F.count("*").alias("n"), F.count_distinct("source_id").alias("sources"))


@CATALOG.add("extract_nested_relations", """
    SELECT type, source_id, target_id, props FROM (
      SELECT 'PLACED_BY' AS type, 'Order:' || o_orderkey AS source_id,
             'Customer:' || o_custkey AS target_id, 'note=' || o_orderpriority AS props FROM orders
      UNION ALL
      SELECT 'RELATED_TO', 'Order:' || o_orderkey, 'Status:' || o_orderstatus, '' FROM orders)""")
def nested(spark, sf):
    orders = read(spark, sf, "orders")
    none = F.lit(None).cast("string")
    order = F.concat(F.lit("Order:"), F.col("o_orderkey").cast("string"))
    listed = orders.select(F.array(
        F.struct(F.lit("PLACED_BY").alias("type"), order.alias("source_id"), none.alias("source"),
                 F.concat(F.lit("Customer:"), F.col("o_custkey").cast("string")).alias("target"),
                 F.col("o_orderpriority").alias("note")),
        F.struct(none.alias("type"), none.alias("source_id"), order.alias("source"),
                 F.concat(F.lit("Status:"), "o_orderstatus").alias("target"),
                 none.alias("note"))).alias("relations"))
    return nested_relations(listed).select("type", "source_id", "target_id",
                                           props_text().alias("props"))


def first_word(row: dict, rules: dict) -> tuple[list[dict], list[dict]]:
    """A turn and the relation to its first word; scores of turns the labels miss are null."""
    words = re.findall(r"[A-Za-z]+", row["text"] or "")
    turn = f"{rules['prefix']}{row['conv_id']}/{row['turn']}"
    if not words:
        return [], []
    key = "none" if row["score"] is None else str(row["score"])
    return ([{"type": "Turn", "id": turn, "properties": {"role": row["role"], "score": key}}],
            [{"type": "STARTS_WITH", "source_id": turn, "target_id": "Word:" + words[0].lower(),
              "source_type": "Turn", "target_type": "Word", "score": key}])


@CATALOG.add("extract_user_function", """
    SELECT 'Turn:' || conv_id || '/' || turn AS source_id,
           'Word:' || lower(regexp_extract(text, '[A-Za-z]+')) AS target_id,
           coalesce((9007199254740993 + CASE WHEN turn % 2 = 0 THEN turn END)::VARCHAR, 'none') AS score
    FROM conversations WHERE regexp_extract(text, '[A-Za-z]+') <> ''""")
def user_function(spark, sf):
    """A nullable whole number beyond 2^53 keeps its digits."""
    turns = read(spark, sf, "conversations").withColumn(
        "score", F.when(F.col("turn") % 2 == 0, F.col("turn") + F.lit(9007199254740993)))
    return extract_with(turns, first_word, {"prefix": "Turn:"}).relations.select(
        "source_id", "target_id", F.element_at("props", "score").alias("score"))


ORDER_RULES = {"entity_type_mapping": {"id": "Order"}}


def order_records(spark, sf):
    return read(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))


@CATALOG.add("extract_entities", """
    SELECT 'Order' AS type, 'Order:' || o_orderkey AS id, 'customer_id=' || o_custkey ||
           '|priority=' || o_orderpriority || '|status=' || o_orderstatus AS props FROM orders""")
def extracted_entities(spark, sf):
    entities, _relations = extract(order_records(spark, sf), ORDER_RULES)
    return entities.select("type", "id", props_text().alias("props"))


@CATALOG.add("extract_relations", """
    SELECT 'HAS_CUSTOMER' AS type, 'Order:' || o_orderkey AS source_id,
           'Customer:' || o_custkey AS target_id, 'Order' AS source_type,
           'Customer' AS target_type FROM orders""")
def extracted_relations(spark, sf):
    _entities, relations = extract(order_records(spark, sf), ORDER_RULES)
    return relations.drop("props")


@CATALOG.add("extract_unguided", """
    SELECT type, COUNT(*) AS n, COUNT(DISTINCT id) AS ids FROM (
      SELECT CASE WHEN user_id <> 0 THEN 'User' ELSE 'Entity' END AS type,
             CASE WHEN user_id <> 0 THEN 'User' ELSE 'Entity' END || ':event_id_' || event_id AS id
      FROM events) GROUP BY 1""")
def unguided(spark, sf):
    events = read(spark, sf, "events")
    entities, _relations = extract(events, default_rules(events.columns))
    return entities.groupBy("type").agg(F.count("*").alias("n"),
                                        F.count_distinct("id").alias("ids"))


# ---- validation -------------------------------------------------------------------------------

def customer_entities(spark, sf):
    rows = read(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("id"),
        F.when(F.col("c_nationkey") != 3, F.col("c_name")).alias("name"),
        F.col("c_acctbal").alias("balance"),
        F.when(F.col("c_nationkey") == 5, F.col("c_mktsegment")).otherwise(
            F.col("c_nationkey").cast("string")).alias("nation"),
        F.col("c_mktsegment").alias("segment"))
    return rows.select(
        F.when(F.col("segment") == "FURNITURE", "Buyer").otherwise("Customer").alias("type"),
        F.concat(F.lit("Customer:"), "id").alias("id"), project_properties(rows).alias("props"))


SQL_CUSTOMER_ERRORS = """
    SELECT id, concat_ws(';',
      CASE WHEN declared AND name IS NULL THEN 'Missing required property: name' END,
      CASE WHEN declared AND TRY_CAST(nation AS BIGINT) IS NULL
           THEN 'Property nation has wrong type. Expected integer, got str' END,
      CASE WHEN declared AND balance < 0 THEN 'Value ' || balance || ' below minimum 0'
           WHEN declared AND balance > 9000 THEN 'Value ' || balance || ' above maximum 9000' END,
      CASE WHEN declared AND NOT regexp_matches(segment, '^(?:[A-M])')
           THEN 'Value ' || segment || ' does not match pattern [A-M]' END) AS errors
    FROM (SELECT 'Customer:' || c_custkey AS id, c_mktsegment <> 'FURNITURE' AS declared,
                 CASE WHEN c_nationkey <> 3 THEN c_name END AS name, c_acctbal AS balance,
                 CASE WHEN c_nationkey = 5 THEN c_mktsegment ELSE c_nationkey::VARCHAR END AS nation,
                 c_mktsegment AS segment FROM customer)"""


@CATALOG.add("validate_entities", f"""
    SELECT id, errors, errors = '' AS is_valid FROM ({SQL_CUSTOMER_ERRORS})""")
def validated(spark, sf):
    return validate_entities(customer_entities(spark, sf), ONTOLOGY).select(
        "id", F.array_join("errors", ";").alias("errors"), "is_valid")


@CATALOG.add("validate_entities_strict", f"""
    SELECT e.id, CASE WHEN c_mktsegment = 'FURNITURE' THEN 'Unknown entity type: Buyer'
                      ELSE errors END AS errors
    FROM ({SQL_CUSTOMER_ERRORS}) e JOIN customer ON e.id = 'Customer:' || c_custkey""")
def validated_strict(spark, sf):
    return validate_entities(customer_entities(spark, sf), ONTOLOGY, strict=True).select(
        "id", F.array_join("errors", ";").alias("errors"))


@CATALOG.add("validate_split", f"""
    SELECT CASE WHEN errors = '' THEN 'valid' ELSE 'quarantine' END AS part, COUNT(*) AS n
    FROM ({SQL_CUSTOMER_ERRORS}) GROUP BY 1""")
def validated_split(spark, sf):
    valid, rest = split_valid(validate_entities(customer_entities(spark, sf), ONTOLOGY))
    parts = valid.select(F.lit("valid").alias("part")).unionByName(
        rest.select(F.lit("quarantine").alias("part")))
    return parts.groupBy("part").agg(F.count("*").alias("n"))


@CATALOG.add("validate_typed_rows", """
    SELECT p_partkey, concat_ws(';',
      CASE WHEN p_size < 5 THEN 'Value ' || p_size || ' below minimum 5'
           WHEN p_size > 45 THEN 'Value ' || p_size || ' above maximum 45' END) AS errors
    FROM part""")
def validated_rows(spark, sf):
    parts = read(spark, sf, "part").select(
        "p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("brand"),
        F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))
    return validate_rows(parts, "Product", ONTOLOGY).select(
        "p_partkey", F.array_join("errors", ";").alias("errors"))


@CATALOG.add("validate_unique", """
    SELECT 'Product' AS type, 'name' AS property, p_name AS value, COUNT(*) AS n
    FROM part GROUP BY p_name HAVING COUNT(*) > 1""")
def unique_values(spark, sf):
    parts = read(spark, sf, "part").select(F.col("p_name").alias("name"))
    customers = read(spark, sf, "customer").select(F.col("c_name").alias("name"))
    entities = parts.select(F.lit("Product").alias("type"), project_properties(parts).alias("props")) \
        .unionByName(customers.select(F.lit("Customer").alias("type"),
                                      project_properties(customers).alias("props")))
    return unique_violations(entities, ONTOLOGY)


@CATALOG.add("validate_relations", """
    SELECT source_id, type, errors FROM (
      SELECT k || ':event_id_' || event_id AS source_id, 'HAS_USER' AS type,
        CASE WHEN k = 'Entity' THEN 'Source type Entity not allowed for relation HAS_USER. '
             || 'Allowed: User, Customer' ELSE '' END AS errors
      FROM (SELECT *, CASE WHEN user_id <> 0 THEN 'User' ELSE 'Entity' END AS k FROM events)
      WHERE user_id <> 0
      UNION ALL
      SELECT k || ':event_id_' || event_id, 'HAS_EVENT', 'Unknown relation type: HAS_EVENT'
      FROM (SELECT *, CASE WHEN user_id <> 0 THEN 'User' ELSE 'Entity' END AS k FROM events)
      WHERE event_id <> 0
      UNION ALL
      SELECT 'Customer:' || c_custkey, 'HAS_NATION', concat_ws(';',
        'Target type Nation not allowed for relation HAS_NATION. '
          || 'Allowed: Customer, Product, Review, Document',
        'Missing required property: since',
        CASE WHEN TRY_CAST(c_mktsegment AS BIGINT) IS NULL
             THEN 'Property weight has wrong type. Expected integer, got str' END)
      FROM customer WHERE c_nationkey <> 0)""")
def validated_relations(spark, sf):
    customers = read(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_nationkey").alias("nation_id"),
        F.col("c_mktsegment").alias("seg"))
    kept = fk_relations(customers, entity_type=F.lit("Customer"), keep=("seg",),
                        entity_id=F.concat(F.lit("Customer:"), "id"))
    nations = kept.withColumn("props", F.create_map(F.lit("weight"), "seg")).drop("seg")
    users = fk_relations(read(spark, sf, "events"))
    return validate_relations(users.unionByName(nations), ONTOLOGY, strict=True).select(
        "source_id", "type", F.array_join("errors", ";").alias("errors"))


