"""Graph construction: de-duplication, merging, upserts, deletes and ingest statistics.

"First" and "last" follow an explicit order column. They are computed by ``min_by`` / ``max_by``
aggregates, not by row numbers: the map-side combine leaves one row per key and task, so a key
held by a large share of all rows is never gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semgraph.functions.values import map_fingerprint

ENTITY = ["workspace_id", "id", "type", "props", "seq"]
RELATION = ["workspace_id", "source_id", "target_id", "type", "source_type", "target_type",
            "props", "seq"]


def pick_one(df: DataFrame, keys: list[str], order: list[Column], first: bool = True) -> DataFrame:
    """One whole row per key: the smallest, or largest, by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    chosen = F.min_by if first else F.max_by
    picked = df.groupBy(*keys).agg(chosen(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def with_fingerprint(entities: DataFrame) -> DataFrame:
    """Add ``fingerprint`` of the properties; type and id do not take part."""
    return entities.withColumn("fingerprint", map_fingerprint(F.col("props")))


def dedupe_entities(entities: DataFrame, order_col: str = "seq") -> DataFrame:
    """Keep the first entity of each workspace and property fingerprint."""
    return pick_one(with_fingerprint(entities), ["workspace_id", "fingerprint"],
                    [F.col(order_col), F.col("id")]).drop("fingerprint").select(*entities.columns)


def entity_id_map(entities: DataFrame, order_col: str = "seq") -> DataFrame:
    """``workspace_id, id, kept_id`` for every entity.

    The kept id is aggregated per fingerprint and joined back; the entity side of that join is the
    one that may be skewed, which AQE splits because the other side has one row per key.
    """
    marked = with_fingerprint(entities).select("workspace_id", "id", order_col, "fingerprint")
    keys = ["workspace_id", "fingerprint"]
    kept = marked.groupBy(*keys).agg(
        F.min(F.struct(order_col, "id")).getField("id").alias("kept_id"))
    return marked.join(kept, keys).select("workspace_id", "id", "kept_id")


def rewrite_endpoints(relations: DataFrame, id_map: DataFrame) -> DataFrame:
    """Point relations at the kept ids (opt-in; construction itself leaves endpoints alone)."""
    moved = id_map.filter("id <> kept_id").dropDuplicates(["workspace_id", "id"])
    for end in ("source_id", "target_id"):
        side = moved.select("workspace_id", F.col("id").alias(end), F.col("kept_id").alias("_to"))
        relations = (relations.join(side, ["workspace_id", end], "left")
                     .withColumn(end, F.coalesce("_to", end)).drop("_to"))
    return relations


def clean_relations(relations: DataFrame) -> DataFrame:
    """Fill the default type, accept ``source`` / ``target`` as fall-back columns and drop
    relations without both ends."""
    def end(name: str) -> Column:
        options = [c for c in (f"{name}_id", name) if c in relations.columns]
        return F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in options])

    kind = F.col("type") if "type" in relations.columns else F.lit(None).cast("string")
    filled = (relations.withColumn("source_id", end("source"))
              .withColumn("target_id", end("target"))
              .withColumn("type", F.coalesce(kind, F.lit("RELATED_TO"))))
    return (filled.drop("source", "target")
            .filter(F.col("source_id").isNotNull() & F.col("target_id").isNotNull()))


def merge_relations(relations: DataFrame, keep: str = "first",
                    order_col: str = "seq") -> DataFrame:
    """One relation per workspace, ends and type; the first or the last one stays."""
    return pick_one(relations, ["workspace_id", "source_id", "target_id", "type"],
                    [F.col(order_col)], keep == "first")


def upsert_entities(base: DataFrame, new: DataFrame, mode: str = "replace",
                    order_col: str = "seq") -> DataFrame:
    """Write ``new`` over ``base`` by workspace and id.

    ``replace`` keeps the last write whole; ``merge`` overlays properties, the last write of each
    key winning. Rows of ``new`` come after all rows of ``base``, then by ``order_col``.
    """
    both = (base.select(*ENTITY).withColumn("_wave", F.lit(0))
            .unionByName(new.select(*ENTITY).withColumn("_wave", F.lit(1))))
    order = [F.col("_wave"), F.col(order_col)]
    keys = ["workspace_id", "id"]
    if mode == "replace":
        return pick_one(both, keys, order, first=False).drop("_wave")
    values = both.select(*keys, "_wave", order_col, F.explode("props").alias("key", "value"))
    latest = values.groupBy(*keys, "key").agg(F.max_by("value", F.struct(*order)).alias("value"))
    heads = both.groupBy(*keys).agg(
        F.max_by(F.struct("type", "seq"), F.struct(*order)).alias("_head"))
    maps = latest.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("props"))
    empty = F.expr("map_from_entries(cast(array() as array<struct<key:string,value:string>>))")
    return (heads.join(maps, keys, "left")
            .select(*keys, "_head.type", F.coalesce("props", empty).alias("props"), "_head.seq"))


def delete_entities(entities: DataFrame, relations: DataFrame, ids: DataFrame | list[str],
                    workspace: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Remove entities and every relation that touches them."""
    if isinstance(ids, list):
        gone_entity, gone_source, gone_target = (
            F.col(c).isin(ids) for c in ("id", "source_id", "target_id"))
        if workspace is not None:
            here = F.col("workspace_id") == workspace
            gone_entity, gone_source, gone_target = (
                gone_entity & here, gone_source & here, gone_target & here)
        return entities.filter(~gone_entity), relations.filter(~(gone_source | gone_target))
    if workspace is not None:
        ids = ids.withColumn("workspace_id", F.lit(workspace))
    keys = [c for c in ("workspace_id", "id") if c in ids.columns]
    gone = ids.select(*keys).distinct()
    left = relations
    for end in ("source_id", "target_id"):
        side = gone.withColumnRenamed("id", end)
        left = left.join(side, [end if k == "id" else k for k in keys], "left_anti")
    return entities.join(gone, keys, "left_anti"), left.select(*relations.columns)


def ingest_stats(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Added and skipped per kind; a duplicate counts as added."""
    has_id = F.col("id").isNotNull() & (F.col("id") != "")
    linked = [F.col(c).isNotNull() & (F.col(c) != "") for c in ("source_id", "target_id")]
    both = linked[0] & linked[1]
    counts = entities.select(F.lit("entities").alias("kind"), has_id.alias("ok")).unionByName(
        relations.select(F.lit("relations").alias("kind"), both.alias("ok")))
    return counts.agg(*[
        F.count_if((F.col("kind") == kind) & (F.col("ok") if name == "added" else ~F.col("ok")))
        .alias(f"{kind}_{name}") for kind in ("entities", "relations")
        for name in ("added", "skipped")])
