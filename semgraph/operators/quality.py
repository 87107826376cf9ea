"""Quality scores of many ontologies: completeness, consistency, coherence, coverage, structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Score weights, grades and recognised names (fixed values).
WEIGHTS = {"completeness": 0.25, "consistency": 0.25, "coherence": 0.20, "coverage": 0.15,
           "structure": 0.15}
GRADES = ((0.9, "A"), (0.8, "B"), (0.7, "C"), (0.6, "D"))
COMMON_PROPERTIES = ("id", "name", "type", "created_at", "updated_at")
VALID_TYPES = ("string", "integer", "float", "date", "datetime", "text", "boolean")


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _steps(value: Column, *steps: tuple[float, float]) -> Column:
    """Score of the first step ``value`` reaches, highest first."""
    out = F.lit(0.0)
    for low, score in reversed(steps):
        out = F.when(value >= low, F.lit(score)).otherwise(out)
    return out


def _facts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per ontology with every count the scores need.

    Each part table is reduced to one row per ontology; the rows are stacked and folded together
    in one more small grouping.
    """
    key = "ontology_id"
    props = tables["properties"]
    bad_type = ~F.col("type").isin(*VALID_TYPES)
    common = F.lower("name").isin(*COMMON_PROPERTIES)
    of_entity = F.col("owner_kind") == "entity"
    per_owner = props.groupBy(key, "owner_kind", "owner_pos").agg(
        F.count("*").alias("n"), F.count_if(common).alias("common"),
        F.count_if(bad_type).alias("bad"), F.count_if("indexed").alias("indexed"),
        F.count_if("required").alias("required"))
    prop_facts = per_owner.groupBy(key).agg(
        F.count_if(of_entity).alias("with_props"),
        F.count_if(of_entity & (F.col("common") > 0)).alias("with_common"),
        F.sum("bad").alias("bad_types"),
        F.sum(F.when(of_entity, F.col("n")).otherwise(0)).alias("entity_props"),
        F.sum(F.when(~of_entity, F.col("n")).otherwise(0)).alias("relation_props"),
        F.sum(F.when(of_entity, F.col("indexed")).otherwise(0)).alias("indexed"),
        F.sum(F.when(of_entity, F.col("required")).otherwise(0)).alias("required"))

    name, first = F.col("name"), F.substring("name", 1, 1)
    snake = name.contains("_")
    upper_first = (first == F.upper(first)) & (first != F.lower(first))
    lower_first = (first == F.lower(first)) & (first != F.upper(first))
    described = F.coalesce(F.col("description"), F.lit("")) != ""
    by_name = tables["entities"].groupBy(key, "name").agg(
        F.count("*").alias("n"), F.count_if(described).alias("described"))
    entity_facts = by_name.groupBy(key).agg(
        F.sum("n").alias("n_entities"), F.count_if(F.col("n") > 1).alias("dup_entities"),
        F.sum(F.when(upper_first & ~snake, F.col("n")).otherwise(0)).alias("pascal"),
        F.sum(F.when(lower_first & ~snake, F.col("n")).otherwise(0)).alias("camel"),
        F.sum(F.when(snake, F.col("n")).otherwise(0)).alias("snake"),
        F.sum("described").alias("described"))

    shouting = ((name == F.upper(name)) & (name != F.lower(name))) | snake
    rel_names = tables["relations"].groupBy(key, "name").agg(
        F.count("*").alias("n"), F.count_if(~F.col("directed")).alias("undirected"))
    relation_facts = rel_names.groupBy(key).agg(
        F.sum("n").alias("n_relations"), F.count_if(F.col("n") > 1).alias("dup_relations"),
        F.sum(F.when(shouting, F.col("n")).otherwise(0)).alias("shouting"),
        F.sum("undirected").alias("undirected"))

    ends = tables["relations"].select(
        key, F.explode(F.concat("sources", "targets")).alias("name")).filter("name <> '*'")
    known = tables["entities"].select(key, "name").distinct()
    end_facts = ends.join(known, [key, "name"], "left_anti").groupBy(key).agg(
        F.count("*").alias("bad_ends"))

    meta = tables["meta"].select(key, "version", "n_hierarchies")
    parts = [prop_facts, entity_facts, relation_facts, end_facts]
    stacked = meta
    for part in parts:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    names = [c for c in stacked.columns if c not in (key, "version")]
    return stacked.groupBy(key).agg(
        F.max("version").alias("version"),
        *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in names])


def schema_quality(tables: dict[str, DataFrame]) -> DataFrame:
    """Scores, weighted quality, grade and recommendations per ontology.

    ``tables`` has the layout of ``Ontology.tables``: meta, entities, relations, properties.
    """
    facts = _facts(tables)
    n_e, n_r = F.col("n_entities"), F.col("n_relations")
    n_p = F.col("entity_props")
    coverage_props = _ratio(F.col("with_props"), n_e)
    indexing, required = _ratio(F.col("indexed"), n_p), _ratio(F.col("required"), n_p)
    naming = _ratio(F.greatest("pascal", "camel", "snake"), n_e)
    dup_e = F.when(F.col("dup_entities") > 0, 1).otherwise(0)
    dup_r = F.when(F.col("dup_relations") > 0, 1).otherwise(0)
    issues = dup_e + dup_r + F.col("bad_ends") + F.col("bad_types")

    completeness = F.least(F.lit(1.0), _steps(n_e, (3, 0.3), (1, 0.15)) + _steps(
        n_r, (2, 0.3), (1, 0.15)) + coverage_props * 0.2 + _ratio(F.col("with_common"), n_e) * 0.2)
    consistency = F.greatest(F.lit(0.0), F.lit(1.0) - dup_e * 0.2 - dup_r * 0.2
                             - F.least(F.lit(0.3), F.col("bad_ends") * 0.05)
                             - F.least(F.lit(0.2), F.col("bad_types") * 0.02))
    coherence = F.least(
        F.lit(1.0), F.when(F.col("n_hierarchies") > 0, 0.3).otherwise(0.0) + naming * 0.2
        + _ratio(F.col("shouting"), n_r) * 0.2 + F.least(F.lit(0.1), F.col("undirected") * 0.05)
        + _ratio(F.col("described"), n_e) * 0.2)
    coverage = F.least(F.lit(1.0), _steps(n_e, (5, 0.4), (3, 0.3), (1, 0.15)) + _steps(
        n_r, (5, 0.3), (2, 0.2), (1, 0.1)) + _steps(_ratio(n_p, n_e), (3, 0.2), (1, 0.1))
        + _steps(_ratio(F.col("relation_props"), n_r), (1, 0.1)))
    structure = F.least(
        F.lit(1.0), indexing * 0.3 + required * 0.3
        + F.when(F.coalesce(F.col("version"), F.lit("")) != "", 0.2).otherwise(0.0)
        + F.when(F.col("n_hierarchies") > 0, 0.2).otherwise(0.0))
    scored = facts.select(
        "ontology_id", n_e.alias("entity_count"), n_r.alias("relation_count"),
        issues.alias("issue_count"), "n_hierarchies", coverage_props.alias("_coverage"),
        naming.alias("_naming"), indexing.alias("_indexing"), required.alias("_required"),
        completeness.alias("completeness"), consistency.alias("consistency"),
        coherence.alias("coherence"), coverage.alias("coverage"), structure.alias("structure"))
    total = sum((F.col(n) * w for n, w in WEIGHTS.items()), F.lit(0.0))
    grade = F.lit("F")
    for low, letter in reversed(GRADES):
        grade = F.when(F.col("quality_score") >= low, letter).otherwise(grade)

    low = {n: F.col(n) < 0.7 for n in WEIGHTS}
    codes = (
        ("few_entities", low["completeness"] & (F.col("entity_count") < 3), "fewer than three kinds of entity"),
        ("few_relations", low["completeness"] & (F.col("relation_count") < 2), "fewer than two kinds of relation"),
        ("bare_entities", low["completeness"] & (F.col("_coverage") < 0.8), "many entities have no property"),
        ("issues", (F.col("consistency") < 0.8) & (F.col("issue_count") > 0), "names, ends or types to mend"),
        ("no_hierarchy", low["coherence"] & (F.col("n_hierarchies") == 0), "no entity is placed under another"),
        ("mixed_names", low["coherence"] & (F.col("_naming") < 0.8), "names follow several spellings"),
        ("narrow", low["coverage"], "the domain is covered thinly"),
        ("few_indexes", low["structure"] & (F.col("_indexing") < 0.5), "under half of the properties are indexed"),
        ("few_required", low["structure"] & (F.col("_required") < 0.3), "few properties are required"))
    advice = F.array_compact(F.array(*[F.when(when, F.lit(f"{code}: {text}")) for code, when, text in codes]))
    return (scored.withColumn("quality_score", total).withColumn("grade", grade)
            .withColumn("recommendations", advice)
            .drop("_coverage", "_naming", "_indexing", "_required", "n_hierarchies"))
