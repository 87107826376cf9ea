"""Graph construction and graph queries.

The retail graph holds every region, nation, supplier, customer and order as an entity of workspace
``retail`` and their foreign keys as relations; workspace ``events`` holds the event table.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from catalog.base import Catalog, props_text, read
from semgraph.operators.extract import extract, project_properties
from semgraph.operators.graph_build import (clean_relations, dedupe_entities, delete_entities,
                                            entity_id_map, ingest_stats, merge_relations,
                                            rewrite_endpoints, upsert_entities, with_fingerprint)
from semgraph.operators.graph_query import (all_paths, get_entity, graph_query, graph_stats,
                                            list_types, neighbors, query_entities,
                                            query_relations, search_entities, shortest_path,
                                            shortest_paths)
from semgraph.operators.text_index import search_indexed, write_text_index
from semgraph.operators.triples import (RDF_TYPE, match_triples, read_triples, to_triples,
                                        triple_neighbors, triple_stats, write_triples)
from semgraph.session import scratch_dir
from semgraph.sources.graph_tables import read_graph, write_graph

CATALOG = Catalog()

SOURCES = {
    "Region": ("region", {"id": "r_regionkey", "name": "r_name"}),
    "Nation": ("nation", {"id": "n_nationkey", "name": "n_name", "region_id": "n_regionkey"}),
    "Supplier": ("supplier", {"id": "s_suppkey", "name": "s_name", "nation_id": "s_nationkey"}),
    "Customer": ("customer", {"id": "c_custkey", "name": "c_name", "nation_id": "c_nationkey",
                              "segment": "c_mktsegment"}),
    "Order": ("orders", {"id": "o_orderkey", "customer_id": "o_custkey",
                         "status": "o_orderstatus", "priority": "o_orderpriority"}),
}


def build_retail(spark, sf):
    entities, relations = [], []
    for kind, (table, columns) in SOURCES.items():
        rows = read(spark, sf, table).select(
            *[F.col(c).cast("string").alias(name) for name, c in columns.items()],
            F.lit("retail").alias("workspace_id"), F.col(columns["id"]).cast("long").alias("seq"))
        e, r = extract(rows, {"entity_type_mapping": {"id": kind}}, keep=("workspace_id", "seq"))
        entities.append(e)
        relations.append(r)
    return tuple(reduce(lambda a, b: a.unionByName(b), parts) for parts in (entities, relations))


def build_events(spark, sf):
    rows = read(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string"), "event_type",
        F.lit("events").alias("workspace_id"), F.col("event_id").alias("seq"))
    return extract(rows, {"entity_type_mapping": {"id": "Event"}}, keep=("workspace_id", "seq"))


_WRITTEN: dict[tuple[str, ...], str] = {}


def whole_graph(spark, sf):
    """Entities and relations of both workspaces, extracted and written once per application as
    graph tables partitioned by workspace."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _WRITTEN:
        pairs = zip(build_retail(spark, sf), build_events(spark, sf), strict=True)
        path = f"{scratch_dir(spark)}/graph-{uuid.uuid4().hex}"
        write_graph(*[a.unionByName(b) for a, b in pairs], path)
        _WRITTEN[key] = path
    return read_graph(spark, _WRITTEN[key])


def laid_out_triples(spark, sf):
    """Triples by graph and predicate, and their counts, written once per application."""
    key = (spark.sparkContext.applicationId, sf, "triples")
    if key not in _WRITTEN:
        path = f"{scratch_dir(spark)}/triples-{uuid.uuid4().hex}"
        write_triples(to_triples(*whole_graph(spark, sf)), path)
        _WRITTEN[key] = path
    return read_triples(spark, _WRITTEN[key])


def stored_triples(spark, sf):
    return laid_out_triples(spark, sf)[0]


def retail_graph(spark, sf):
    return tuple(df.filter("workspace_id = 'retail'") for df in whole_graph(spark, sf))


# The same graph for the checking engine.
ENT = """ent AS (
    SELECT 'retail' AS ws, 'Region:' || r_regionkey AS id, 'Region' AS type,
           'name=' || r_name AS props, r_name AS name, NULL AS segment, r_regionkey AS seq FROM region
    UNION ALL SELECT 'retail', 'Nation:' || n_nationkey, 'Nation',
           'name=' || n_name || '|region_id=' || n_regionkey, n_name, NULL, n_nationkey FROM nation
    UNION ALL SELECT 'retail', 'Supplier:' || s_suppkey, 'Supplier',
           'name=' || s_name || '|nation_id=' || s_nationkey, s_name, NULL, s_suppkey FROM supplier
    UNION ALL SELECT 'retail', 'Customer:' || c_custkey, 'Customer', 'name=' || c_name ||
           '|nation_id=' || c_nationkey || '|segment=' || c_mktsegment, c_name, c_mktsegment,
           c_custkey FROM customer
    UNION ALL SELECT 'retail', 'Order:' || o_orderkey, 'Order', 'customer_id=' || o_custkey ||
           '|priority=' || o_orderpriority || '|status=' || o_orderstatus, NULL, NULL, o_orderkey
           FROM orders
    UNION ALL SELECT 'events', 'Event:' || event_id, 'Event', 'event_type=' || event_type ||
           '|user_id=' || user_id, NULL, NULL, event_id FROM events)"""
REL = """rel AS (
    SELECT 'retail' AS ws, 'Nation:' || n_nationkey AS s, 'Region:' || n_regionkey AS t,
           'HAS_REGION' AS type FROM nation
    UNION ALL SELECT 'retail', 'Supplier:' || s_suppkey, 'Nation:' || s_nationkey, 'HAS_NATION'
           FROM supplier
    UNION ALL SELECT 'retail', 'Customer:' || c_custkey, 'Nation:' || c_nationkey, 'HAS_NATION'
           FROM customer
    UNION ALL SELECT 'retail', 'Order:' || o_orderkey, 'Customer:' || o_custkey, 'HAS_CUSTOMER'
           FROM orders
    UNION ALL SELECT 'events', 'Event:' || event_id, 'User:' || user_id, 'HAS_USER' FROM events)"""
GRAPH = f"{ENT}, {REL}"

TRIM = r"trim({}, chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '||chr(133)||chr(160)||chr(5760)||chr(8192)||chr(8193)||chr(8194)||chr(8195)||chr(8196)||chr(8197)||chr(8198)||chr(8199)||chr(8200)||chr(8201)||chr(8202)||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288))"


# ---- construction -----------------------------------------------------------------------------

def document_entities(spark, sf):
    docs = read(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("id"), "text", F.col("doc_id").alias("seq"))
    return docs.select(F.lit("docs").alias("workspace_id"), F.concat(F.lit("Document:"), "id").alias("id"),
                       F.lit("Document").alias("type"),
                       project_properties(docs.select("id", "text")).alias("props"), "seq")


DOC_KEY = TRIM.format("lower(text)")


@CATALOG.add("graph_deduped_documents", f"""
    SELECT 'Document:' || MIN(doc_id) AS id FROM documents GROUP BY {DOC_KEY}""")
def deduped(spark, sf):
    return dedupe_entities(document_entities(spark, sf)).select("id")


@CATALOG.add("graph_deduped_entities", f"""
    WITH {ENT} SELECT ws AS workspace_id, arg_min(id, (seq, id)) AS id, COUNT(*) AS copies
    FROM ent GROUP BY ws, lower(props)""")
def deduped_entities(spark, sf):
    """Orders that share customer, status and priority fall together, type and id left out."""
    entities, _r = whole_graph(spark, sf)
    kept = dedupe_entities(entities).select("workspace_id", "id")
    copies = entity_id_map(entities).groupBy("workspace_id", F.col("kept_id").alias("id")).agg(
        F.count("*").alias("copies"))
    return kept.join(copies, ["workspace_id", "id"])


@CATALOG.add("graph_entity_id_map", f"""
    SELECT 'Document:' || doc_id AS id,
           'Document:' || MIN(doc_id) OVER (PARTITION BY {DOC_KEY}) AS kept_id FROM documents""")
def id_map(spark, sf):
    return entity_id_map(document_entities(spark, sf)).select("id", "kept_id")


@CATALOG.add("graph_rewritten_endpoints", f"""
    SELECT target_id, COUNT(*) AS n FROM (
      SELECT 'Document:' || MIN(doc_id) OVER (PARTITION BY {DOC_KEY}) AS target_id FROM documents)
    GROUP BY 1""")
def rewritten(spark, sf):
    entities = document_entities(spark, sf)
    relations = read(spark, sf, "documents").select(
        F.lit("docs").alias("workspace_id"), F.concat(F.lit("Source:"), "source").alias("source_id"),
        F.concat(F.lit("Document:"), F.col("doc_id").cast("string")).alias("target_id"))
    return rewrite_endpoints(relations, entity_id_map(entities)).groupBy("target_id").agg(
        F.count("*").alias("n"))


def user_actions(spark, sf):
    events = read(spark, sf, "events")
    return events.select(
        F.lit("events").alias("workspace_id"),
        F.concat(F.lit("User:"), F.col("user_id").cast("string")).alias("source_id"),
        F.concat(F.lit("Action:"), "event_type").alias("target_id"),
        F.when(F.col("value") >= 5, F.lit("DID")).alias("type"),
        F.lit("User").alias("source_type"), F.lit("Action").alias("target_type"),
        F.create_map(F.lit("value"), F.col("value").cast("string")).alias("props"),
        F.col("event_id").alias("seq"))


ACTIONS = """acts AS (SELECT 'User:' || user_id AS source_id, 'Action:' || event_type AS target_id,
    CASE WHEN value >= 5 THEN 'DID' ELSE 'RELATED_TO' END AS type, value, event_id FROM events)"""


@CATALOG.add("graph_clean_relations", """
    SELECT COALESCE(NULLIF('User:' || NULLIF(user_id, 0), ''), 'Type:' || event_type) AS source_id,
           'Event:' || event_id AS target_id, COALESCE(kind, 'RELATED_TO') AS type
    FROM (SELECT *, CASE WHEN value > 3 THEN 'DID' END AS kind FROM events)
    WHERE event_type <> 'error' OR user_id <> 0""")
def cleaned(spark, sf):
    events = read(spark, sf, "events")
    raw = events.select(
        F.when(F.col("user_id") != 0, F.concat(F.lit("User:"), F.col("user_id").cast("string")))
        .alias("source_id"),
        F.when(F.col("event_type") != "error", F.concat(F.lit("Type:"), "event_type")).alias("source"),
        F.concat(F.lit("Event:"), F.col("event_id").cast("string")).alias("target_id"),
        F.when(F.col("value") > 3, "DID").alias("type"))
    return clean_relations(raw).select("source_id", "target_id", "type")


@CATALOG.add("graph_merged_relations_first", f"""
    WITH {ACTIONS} SELECT source_id, target_id, type, MIN(event_id) AS seq,
           arg_min(value, event_id) AS value FROM acts GROUP BY 1, 2, 3""")
def merged_first(spark, sf):
    merged = merge_relations(clean_relations(user_actions(spark, sf)), "first")
    return merged.select("source_id", "target_id", "type", "seq",
                         F.col("props")["value"].cast("double").alias("value"))


@CATALOG.add("graph_merged_relations_last", f"""
    WITH {ACTIONS} SELECT source_id, target_id, type, MAX(event_id) AS seq,
           arg_max(value, event_id) AS value FROM acts GROUP BY 1, 2, 3""")
def merged_last(spark, sf):
    merged = merge_relations(clean_relations(user_actions(spark, sf)), "last")
    return merged.select("source_id", "target_id", "type", "seq",
                         F.col("props")["value"].cast("double").alias("value"))


def _waves(spark, sf):
    """Customers as first written, and a write per order to its customer's entity."""
    base = read(spark, sf, "customer").select(
        F.lit("retail").alias("workspace_id"), F.col("c_custkey").cast("string").alias("id"),
        F.lit("Customer").alias("type"),
        F.create_map(F.lit("name"), "c_name", F.lit("segment"), "c_mktsegment").alias("props"),
        F.lit(0).cast("long").alias("seq"))
    new = read(spark, sf, "orders").select(
        F.lit("retail").alias("workspace_id"), F.col("o_custkey").cast("string").alias("id"),
        F.lit("Buyer").alias("type"),
        F.create_map(F.lit("segment"), "o_orderpriority",
                     F.concat(F.lit("last_"), "o_orderstatus"),
                     F.col("o_orderkey").cast("string")).alias("props"),
        F.col("o_orderkey").alias("seq"))
    return base, new


@CATALOG.add("graph_upsert_replace", """
    SELECT c_custkey::VARCHAR AS id,
           CASE WHEN k IS NULL THEN 'Customer' ELSE 'Buyer' END AS type,
           CASE WHEN k IS NULL THEN 'name=' || c_name || '|segment=' || c_mktsegment
                ELSE 'last_' || st || '=' || k || '|segment=' || pr END AS props
    FROM customer LEFT JOIN (
      SELECT o_custkey, MAX(o_orderkey) AS k, arg_max(o_orderstatus, o_orderkey) AS st,
             arg_max(o_orderpriority, o_orderkey) AS pr FROM orders GROUP BY 1)
    ON o_custkey = c_custkey""")
def upsert_replaced(spark, sf):
    return upsert_entities(*_waves(spark, sf)).select("id", "type", props_text().alias("props"))


@CATALOG.add("graph_upsert_merge", """
    SELECT c_custkey::VARCHAR AS id, CASE WHEN k IS NULL THEN 'Customer' ELSE 'Buyer' END AS type,
           concat_ws('|', 'last_F=' || f, 'last_O=' || o, 'last_P=' || p, 'name=' || c_name,
                     'segment=' || COALESCE(pr, c_mktsegment)) AS props
    FROM customer LEFT JOIN (
      SELECT o_custkey, MAX(o_orderkey) AS k, arg_max(o_orderpriority, o_orderkey) AS pr,
             MAX(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS f,
             MAX(CASE WHEN o_orderstatus = 'O' THEN o_orderkey END) AS o,
             MAX(CASE WHEN o_orderstatus = 'P' THEN o_orderkey END) AS p
      FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def upsert_merged(spark, sf):
    return upsert_entities(*_waves(spark, sf), mode="merge").select(
        "id", "type", props_text().alias("props"))


@CATALOG.add("graph_ingest_stats", f"""
    WITH {GRAPH} SELECT (SELECT COUNT(*) FROM ent) AS entities_added, 0 AS entities_skipped,
      (SELECT COUNT(*) FROM rel) + (SELECT COUNT(*) FROM events WHERE user_id <> 0) AS relations_added,
      (SELECT COUNT(*) FROM events WHERE user_id = 0) AS relations_skipped""")
def stats_of_ingest(spark, sf):
    entities, relations = whole_graph(spark, sf)
    loose = read(spark, sf, "events").select(
        F.when(F.col("user_id") != 0, F.col("user_id").cast("string")).alias("source_id"),
        F.col("event_type").alias("target_id"))
    return ingest_stats(entities, relations.select("source_id", "target_id").unionByName(loose))


@CATALOG.add("graph_delete", f"""
    WITH {GRAPH}, gone AS (SELECT 'Customer:' || c_custkey AS id FROM customer WHERE c_acctbal < 0)
    SELECT 'entity' AS kind, type, COUNT(*) AS n FROM ent WHERE id NOT IN (SELECT id FROM gone)
    GROUP BY type
    UNION ALL SELECT 'relation', type, COUNT(*) FROM rel
    WHERE s NOT IN (SELECT id FROM gone) AND t NOT IN (SELECT id FROM gone) GROUP BY type""")
def deleted(spark, sf):
    gone = read(spark, sf, "customer").filter("c_acctbal < 0").select(
        F.concat(F.lit("Customer:"), F.col("c_custkey").cast("string")).alias("id"))
    entities, relations = delete_entities(*whole_graph(spark, sf), gone)
    return entities.groupBy(F.lit("entity").alias("kind"), "type").agg(F.count("*").alias("n")) \
        .unionByName(relations.groupBy(F.lit("relation").alias("kind"), "type").agg(
            F.count("*").alias("n")))


@CATALOG.add("graph_fingerprints", f"""
    SELECT md5('text' || chr(31) || {DOC_KEY}) AS fingerprint, COUNT(*) AS n
    FROM documents GROUP BY 1""")
def fingerprints(spark, sf):
    return with_fingerprint(document_entities(spark, sf)).groupBy("fingerprint").agg(
        F.count("*").alias("n"))


# ---- queries ----------------------------------------------------------------------------------

@CATALOG.add("graph_get_entity", f"""
    WITH {ENT} SELECT id, type, props FROM ent WHERE id = 'Customer:7' AND ws = 'retail'""")
def one_entity(spark, sf):
    entities, _r = whole_graph(spark, sf)
    return get_entity(entities, "Customer:7", "retail").select("id", "type", props_text().alias("props"))


@CATALOG.add("graph_query_entities", f"""
    WITH {ENT} SELECT id, props FROM ent WHERE type = 'Customer' AND segment = 'MACHINERY'
    ORDER BY id""")
def entities_by_filter(spark, sf):
    entities, _r = whole_graph(spark, sf)
    found = query_entities(entities, "Customer", {"segment": "MACHINERY"}, workspace="retail")
    return found.select("id", props_text().alias("props"))


@CATALOG.add("graph_search_text", f"""
    WITH {ENT} SELECT id FROM ent WHERE ws = 'retail' AND (name ILIKE '%00001%' OR id ILIKE '%00001%')
    ORDER BY id""")
def search_text(spark, sf):
    entities, _r = whole_graph(spark, sf)
    return search_entities(entities, "00001", workspace="retail").select("id")


@CATALOG.add("graph_search_indexed", f"""
    WITH {ENT} SELECT ws AS workspace_id, id FROM ent
    WHERE contains(lower(id || chr(1) || type || chr(1) || ws || chr(1) || props), '999')""")
def search_by_index(spark, sf):
    """Ids, types and property values that hold the text, of both workspaces, through the posting lists."""
    entities, _r = whole_graph(spark, sf)
    key = (spark.sparkContext.applicationId, sf, "text index")
    if key not in _WRITTEN:
        path = f"{scratch_dir(spark)}/grams-{uuid.uuid4().hex}"
        write_text_index(entities, path)
        _WRITTEN[key] = path
    return search_indexed(entities, _WRITTEN[key], "999").select("workspace_id", "id")


@CATALOG.add("graph_search_exact", f"""
    WITH {ENT} SELECT ws AS workspace_id, id FROM ent WHERE id = 'Order:1'""")
def search_exact(spark, sf):
    """Other order ids contain the text, the exact one alone is returned."""
    entities, _r = whole_graph(spark, sf)
    return search_entities(entities, "Order:1").select("workspace_id", "id")


@CATALOG.add("graph_query_relations", f"""
    WITH {REL} SELECT s AS source_id, t AS target_id FROM rel
    WHERE type = 'HAS_NATION' AND t = 'Nation:3' ORDER BY s""")
def relations_by_filter(spark, sf):
    _e, relations = whole_graph(spark, sf)
    return query_relations(relations, "HAS_NATION", target_id="Nation:3", workspace="retail").select(
        "source_id", "target_id")


@CATALOG.add("graph_neighbors", f"""
    WITH {GRAPH}, steps AS (
      SELECT ws, s AS node, t AS id, type AS relation, 'out' AS direction FROM rel
      UNION ALL SELECT ws, t, s, type, 'in' FROM rel)
    SELECT node, relation, direction, COUNT(*) AS n FROM steps JOIN ent USING (ws, id)
    GROUP BY 1, 2, 3""")
def all_neighbors(spark, sf):
    """Every node's neighbours; event users have no entity row and drop out."""
    found = neighbors(*whole_graph(spark, sf))
    return found.groupBy("node", "relation", "direction").agg(F.count("*").alias("n"))


@CATALOG.add("graph_neighbors_typed_in", f"""
    WITH {GRAPH} SELECT t AS node, s AS id, ent.props FROM rel JOIN ent ON s = id AND rel.ws = ent.ws
    WHERE rel.type = 'HAS_REGION'""")
def typed_neighbors(spark, sf):
    found = neighbors(*whole_graph(spark, sf), types=["HAS_REGION"], direction="in")
    return found.select("node", "id", props_text().alias("props"))


PATHS = """paths AS (
    SELECT ws, s AS src, t AS node, [s, t] AS path FROM hops WHERE s <> t
    UNION ALL SELECT p.ws, src, h.t, list_append(path, h.t) FROM paths p
    JOIN hops h ON h.ws = p.ws AND h.s = p.node
    WHERE len(path) < {} AND NOT list_contains(path, h.t))"""


@CATALOG.add("graph_shortest_path", f"""
    WITH RECURSIVE {REL}, hops AS (SELECT DISTINCT ws, s, t FROM rel), {PATHS.format(4)}
    SELECT array_to_string(path, '>') AS path, len(path) - 1 AS length FROM paths
    WHERE src = 'Order:3' AND node IN (SELECT 'Region:' || n_regionkey FROM orders
      JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
      WHERE o_orderkey = 3) ORDER BY 2, 1 LIMIT 1""")
def one_shortest_path(spark, sf):
    entities, relations = whole_graph(spark, sf)
    home = (read(spark, sf, "orders").filter("o_orderkey = 3")
            .join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(F.lit("retail").alias("workspace_id"), F.lit("Order:3").alias("src"),
                    F.concat(F.lit("Region:"), F.col("n_regionkey").cast("string")).alias("dst")))
    found = shortest_paths(relations.filter("workspace_id = 'retail'"), home, 4, entities)
    return found.select(F.array_join("path", ">").alias("path"), "length")


@CATALOG.add("graph_shortest_path_single", f"""
    WITH RECURSIVE {REL}, hops AS (SELECT DISTINCT ws, s, t FROM rel), {PATHS.format(3)}
    SELECT array_to_string(path, '>') AS path, len(path) - 1 AS length FROM paths
    WHERE src = 'Nation:1' AND node = (SELECT 'Region:' || n_regionkey FROM nation
                                      WHERE n_nationkey = 1) ORDER BY 2, 1 LIMIT 1""")
def single_shortest_path(spark, sf):
    _e, relations = whole_graph(spark, sf)
    region = read(spark, sf, "nation").filter("n_nationkey = 1").first()["n_regionkey"]
    found = shortest_path(relations, "Nation:1", f"Region:{region}", workspace="retail")
    return found.select(F.array_join("path", ">").alias("path"), "length")


@CATALOG.add("graph_shortest_paths_all_orders", f"""
    WITH RECURSIVE {REL}, hops AS (SELECT DISTINCT ws, s, t FROM rel), {PATHS.format(4)},
    best AS (SELECT src, node, MIN((len(path), path)) AS b FROM paths
             WHERE src LIKE 'Order:%' AND node LIKE 'Region:%' GROUP BY 1, 2)
    SELECT src, node AS dst, array_to_string(b[2], '>') AS path, b[1] - 1 AS length FROM best""")
def order_paths(spark, sf):
    """From every order to the region it belongs to, four nodes."""
    entities, relations = retail_graph(spark, sf)
    pairs = (read(spark, sf, "orders")
             .join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
             .join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
             .select(F.lit("retail").alias("workspace_id"),
                     F.concat(F.lit("Order:"), F.col("o_orderkey").cast("string")).alias("src"),
                     F.concat(F.lit("Region:"), F.col("n_regionkey").cast("string")).alias("dst")))
    return shortest_paths(relations, pairs, 4, entities).select(
        "src", "dst", F.array_join("path", ">").alias("path"), "length")


@CATALOG.add("graph_all_paths", f"""
    WITH RECURSIVE {GRAPH}, hops AS (SELECT DISTINCT rel.ws, s, t FROM rel JOIN ent
                                     ON ent.ws = rel.ws AND ent.id = t), {PATHS.format(4)}
    SELECT src, array_to_string(path, '>') AS path, len(path) - 1 AS length FROM paths""")
def every_path(spark, sf):
    """All paths of up to four nodes from every node of the graph."""
    entities, relations = whole_graph(spark, sf)
    sources = relations.select("workspace_id", F.col("source_id").alias("src"))
    return all_paths(relations, sources, 4, None, entities).select(
        "src", F.array_join("path", ">").alias("path"), "length")


@CATALOG.add("graph_paths_from", f"""
    WITH RECURSIVE {GRAPH}, hops AS (SELECT DISTINCT rel.ws, s, t FROM rel JOIN ent
                                     ON ent.ws = rel.ws AND ent.id = t), {PATHS.format(3)}
    SELECT array_to_string(path, '>') AS path, len(path) - 1 AS length FROM paths
    WHERE src = 'Order:5' ORDER BY length, path""")
def paths_from(spark, sf):
    """Dispatch of a path question."""
    entities, relations = whole_graph(spark, sf)
    return graph_query(entities, relations, "Order:5", "path", "retail").select(
        F.array_join("path", ">").alias("path"), "length")


@CATALOG.add("graph_dispatch_entity", f"""
    WITH {ENT} SELECT id, type, props FROM ent WHERE ws = 'retail' AND (name ILIKE '%00002%' OR id ILIKE '%00002%')""")
def dispatched_entity(spark, sf):
    return graph_query(*whole_graph(spark, sf), "00002", "entity", "retail").select("id", "type", props_text().alias("props"))


@CATALOG.add("graph_dispatch_relation", f"""
    WITH {REL} SELECT s AS source_id, t AS target_id, type FROM rel WHERE ws = 'retail' AND type = 'HAS_CUSTOMER'""")
def dispatched_relation(spark, sf):
    return graph_query(*whole_graph(spark, sf), "HAS_CUSTOMER", "relation", "retail").select("source_id", "target_id", "type")


@CATALOG.add("graph_dispatch_path", f"""
    WITH {GRAPH}, one AS (SELECT s || ',' || t AS path, t AS node, 1 AS length FROM rel JOIN ent USING (ws)
                          WHERE ws = 'retail' AND s = 'Order:7' AND ent.id = t),
    two AS (SELECT path || ',' || t AS path, t AS node, 2 AS length FROM one JOIN rel ON s = node JOIN ent ON ent.id = t
            WHERE rel.ws = 'retail'),
    three AS (SELECT path || ',' || t AS path, t AS node, 3 AS length FROM two JOIN rel ON s = node JOIN ent ON ent.id = t
              WHERE rel.ws = 'retail')
    SELECT path, length FROM one UNION ALL SELECT path, length FROM two UNION ALL SELECT path, length FROM three""")
def dispatched_path(spark, sf):
    found = graph_query(*whole_graph(spark, sf), "Order:7", "path", "retail", max_depth=4)
    return found.select(F.array_join("path", ",").alias("path"), "length")


@CATALOG.add("graph_dispatch_neighbor", f"""
    WITH {GRAPH}, steps AS (
      SELECT ws, s AS node, t AS id, 'out' AS direction FROM rel
      UNION ALL SELECT ws, t, s, 'in' FROM rel)
    SELECT id, direction FROM steps JOIN ent USING (ws, id) WHERE node = 'Customer:11'""")
def dispatched_neighbor(spark, sf):
    entities, relations = whole_graph(spark, sf)
    return graph_query(entities, relations, "Customer:11", "neighbor", "retail").select(
        "id", "direction")


@CATALOG.add("graph_stats", f"""
    WITH {GRAPH}, nodes AS (SELECT ws, id FROM ent UNION SELECT ws, s FROM rel
                            UNION SELECT ws, t FROM rel)
    SELECT ws AS workspace_id, (SELECT COUNT(*) FROM nodes n WHERE n.ws = w.ws) AS nodes,
      (SELECT COUNT(DISTINCT (s, t)) FROM rel r WHERE r.ws = w.ws) AS edges,
      (SELECT COUNT(*) FROM rel r WHERE r.ws = w.ws) AS relations,
      (SELECT COUNT(DISTINCT type) FROM ent e WHERE e.ws = w.ws) AS entity_types,
      (SELECT COUNT(DISTINCT type) FROM rel r WHERE r.ws = w.ws) AS relation_types
    FROM (SELECT DISTINCT ws FROM ent) w""")
def statistics(spark, sf):
    return graph_stats(*whole_graph(spark, sf))


@CATALOG.add("graph_workspace_types", f"""
    WITH {GRAPH} SELECT DISTINCT ws AS workspace_id, 'entity' AS kind, type FROM ent
    UNION ALL SELECT DISTINCT ws, 'relation', type FROM rel""")
def types(spark, sf):
    return list_types(*whole_graph(spark, sf))


# ---- triples ----------------------------------------------------------------------------------

ENC = "replace(replace(replace({}, ' ', '%20'), '#', '%23'), ':', '%3A')"
TRIPLES = f"""tri AS (
    SELECT ws, 'urn:semgraph/entity/' || {ENC.format('id')} AS s, '{RDF_TYPE}' AS p,
           'urn:semgraph/type/' || type AS o FROM ent
    UNION ALL SELECT ws, 'urn:semgraph/entity/' || {ENC.format('id')}, 'urn:semgraph/property/id', id
           FROM ent
    UNION ALL SELECT ws, 'urn:semgraph/entity/' || {ENC.format('id')}, 'urn:semgraph/property/type',
           type FROM ent
    UNION ALL SELECT ws, 'urn:semgraph/entity/' || {ENC.format('id')},
           'urn:semgraph/property/workspace_id', ws FROM ent
    UNION ALL SELECT ws, 'urn:semgraph/entity/' || {ENC.format('id')},
           'urn:semgraph/property/' || split_part(kv, '=', 1), split_part(kv, '=', 2)
           FROM (SELECT ws, id, unnest(string_split(props, '|')) AS kv FROM ent)
    UNION ALL SELECT ws, 'urn:semgraph/entity/' || {ENC.format('s')},
           'urn:semgraph/relation/' || type, 'urn:semgraph/entity/' || {ENC.format('t')} FROM rel
    UNION ALL SELECT ws, 'urn:semgraph/relation/' || {ENC.format("s || '_' || t || '_' || type")},
           'urn:semgraph/property/workspace_id', ws FROM rel
    UNION ALL SELECT ws, 'urn:semgraph/relation/' || {ENC.format("s || '_' || t || '_' || type")},
           'urn:semgraph/property/type', type FROM rel)"""


@CATALOG.add("triples_all", f"""
    WITH {GRAPH}, {TRIPLES} SELECT 'urn:semgraph/graph/workspace/' || ws AS graph, s, p, o FROM tri""")
def triples(spark, sf):
    return to_triples(*whole_graph(spark, sf)).toDF("graph", "s", "p", "o")


@CATALOG.add("triples_stats", f"""
    WITH {GRAPH}, {TRIPLES} SELECT 'urn:semgraph/graph/workspace/' || ws AS graph,
      COUNT(DISTINCT s) AS nodes, COUNT(*) AS edges FROM tri GROUP BY ws""")
def stats_of_triples(spark, sf):
    return triple_stats(stored_triples(spark, sf))


@CATALOG.add("triples_pattern", """
    SELECT DISTINCT 'urn:semgraph/entity/Order%3A' || o_orderkey AS o, c_name AS name
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'""")
def pattern(spark, sf):
    """Orders of customers in one region, with the customer's name."""
    return asian_orders(spark, sf, ASIAN_ORDERS)


REL_URI, PROP_URI, RETAIL = "urn:semgraph/relation/", "urn:semgraph/property/", "urn:semgraph/graph/workspace/retail"
ASIAN_ORDERS = [
    ("?o", RDF_TYPE, "urn:semgraph/type/Order"),
    ("?o", REL_URI + "HAS_CUSTOMER", "?c"),
    ("?c", PROP_URI + "name", "?name"),
    ("?c", REL_URI + "HAS_NATION", "?n"),
    ("?n", REL_URI + "HAS_REGION", "?r"),
    ("?r", PROP_URI + "name", "ASIA")]


def asian_orders(spark, sf, patterns):
    rows, counts = laid_out_triples(spark, sf)
    return match_triples(rows, patterns, ["o", "name"], graph=RETAIL, counts=counts).select("o", "name")


@CATALOG.add("triples_pattern_reversed", """
    SELECT DISTINCT 'urn:semgraph/entity/Order%3A' || o_orderkey AS o, c_name AS name
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'""")
def pattern_reversed(spark, sf):
    return asian_orders(spark, sf, ASIAN_ORDERS[::-1])


@CATALOG.add("triples_triangle", f"""
    WITH {GRAPH} SELECT DISTINCT 'urn:semgraph/entity/' || {ENC.format('rel.s')} AS c, name, ent.ws AS w
    FROM rel JOIN ent ON ent.id = rel.t WHERE rel.type = 'HAS_NATION'""")
def triangle(spark, sf):
    """A cycle through a literal that every entity holds: in the order written, the first two patterns alone
    would pair all entities."""
    rows, counts = laid_out_triples(spark, sf)
    return match_triples(rows, [
        ("?c", PROP_URI + "workspace_id", "?w"),
        ("?n", PROP_URI + "workspace_id", "?w"),
        ("?n", PROP_URI + "name", "?name"),
        ("?c", REL_URI + "HAS_NATION", "?n")], ["c", "name", "w"], counts=counts).select("c", "name", "w")


@CATALOG.add("triples_pattern_limited", """
    SELECT 'urn:semgraph/entity/Customer%3A' || c_custkey AS c FROM customer
    WHERE c_mktsegment = 'BUILDING' ORDER BY 1 LIMIT 100""")
def pattern_limited(spark, sf):
    found = match_triples(
        stored_triples(spark, sf),
        [("?c", "urn:semgraph/property/segment", "BUILDING"),
         ("?c", "urn:semgraph/property/workspace_id", "retail")], ["c"], 100)
    return found.select("c")


@CATALOG.add("triples_neighbors_union", f"""
    WITH {REL} SELECT direction, node, COUNT(*) AS n FROM (
      SELECT 'out' AS direction, 'urn:semgraph/entity/' || {ENC.format('s')} AS node FROM rel
      UNION ALL SELECT 'in', 'urn:semgraph/entity/' || {ENC.format('t')} FROM rel) GROUP BY 1, 2""")
def union_neighbors(spark, sf):
    return triple_neighbors(stored_triples(spark, sf)).groupBy("direction", "node").agg(
        F.count("*").alias("n"))
