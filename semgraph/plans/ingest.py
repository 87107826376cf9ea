"""Records to graph: extract, validate, de-duplicate, merge, commit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semgraph.operators.extract import extract, map_properties
from semgraph.operators.graph_build import (clean_relations, dedupe_entities, ingest_stats,
                                            merge_relations, pick_one, with_fingerprint)
from semgraph.operators.validate import split_valid, validate_entities, validate_relations
from semgraph.session import materialize
from semgraph.sources.graph_commits import KEYS, commit, compact, live_commits, read_table
from semgraph.sources.ontology import Ontology


def build_graph(records: DataFrame, workspace_id: str, order_col: str,
                ontology: Ontology | None = None, rules: dict | None = None,
                strict: bool = False, store: bool = False) -> dict[str, DataFrame]:
    """Lazy plans of one ingest: ``entities``, ``relations``, ``rejected_entities``,
    ``rejected_relations`` and ``stats`` (one row).

    ``order_col`` decides which of several equal records is first. With ``strict`` invalid entities
    and relations are set aside; without it they are kept. Counts include duplicates, which are
    merged rather than skipped. ``store`` writes what is extracted to the scratch folder, so that
    tables and counts come from one extraction.
    """
    tagged = records.withColumn("workspace_id", F.lit(workspace_id)).withColumn(
        "seq", F.col(order_col).cast("long"))
    entities, relations = extract(tagged, rules, keep=("workspace_id", "seq"))
    if store:
        entities, relations = materialize(entities), materialize(relations)
    rejected_entities, rejected_relations = entities.limit(0), relations.limit(0)
    if ontology is not None:
        entities = map_properties(entities, ontology)
        if strict:
            entities, rejected_entities = split_valid(validate_entities(entities, ontology))
            relations, rejected_relations = split_valid(validate_relations(relations, ontology))
    return {
        "entities": dedupe_entities(entities),
        "relations": merge_relations(clean_relations(relations)),
        "rejected_entities": rejected_entities,
        "rejected_relations": rejected_relations,
        "stats": ingest_stats(entities, relations),
    }


def _not_held(new: DataFrame, held: DataFrame | None, keys: list[str], workspace_id: str) -> DataFrame:
    if held is None:
        return new
    held = held.filter(F.col("workspace_id") == workspace_id).select(*[F.col(k).alias(f"_{k}") for k in keys])
    return new.join(held, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), "left_anti")


def ingest(records: DataFrame, workspace_id: str, order_col: str, path: str, ontology: Ontology | None = None,
           rules: dict | None = None, strict: bool = False, compact_after: int = 32) -> DataFrame:
    """Build the graph of the records and commit what the workspace lacks under ``path``; both tables change at
    once, and a run that fails changes nothing. Returns ``stats`` of the records.

    Of equal properties the entity stored first stays; other entities replace the one with their id, the last of
    one ingest winning. Of equal relations the one stored first stays. Every fingerprint seen is kept, so
    repeating an ingest changes nothing, and only fingerprints and relation keys of what is stored are read. More than
    ``compact_after`` commits are written as one.
    """
    spark = records.sparkSession
    graph = build_graph(records, workspace_id, order_col, ontology, rules, strict, store=True)
    seen, entities, relations = (read_table(spark, path, t) for t in ("fingerprints", "entities", "relations"))
    fresh = materialize(_not_held(with_fingerprint(graph["entities"]), seen, KEYS["fingerprints"], workspace_id))
    last = pick_one(fresh, KEYS["entities"], [F.col("seq"), F.col("fingerprint")], first=False).drop("fingerprint")
    gone = {}
    if entities is not None:
        here = entities.filter(F.col("workspace_id") == workspace_id).select(*KEYS["entities"])
        replaced = materialize(here.join(fresh.select(*KEYS["entities"]).distinct(), KEYS["entities"], "left_semi"))
        gone = {} if replaced.isEmpty() else {"entities": replaced}
    commit(spark, path, {
        "entities": last, "fingerprints": fresh.select(*KEYS["fingerprints"]),
        "relations": _not_held(graph["relations"], relations, KEYS["relations"], workspace_id)}, gone)
    if len(live_commits(spark, path)) > compact_after:
        compact(spark, path)
    return graph["stats"]
