"""Entity, relation, neighbour and path queries on the graph tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semgraph.session import materialize


def in_workspace(df: DataFrame, workspace: str | None) -> DataFrame:
    """Rows of one workspace; on tables partitioned by workspace this prunes files."""
    return df if workspace is None else df.filter(F.col("workspace_id") == workspace)


def get_entity(entities: DataFrame, entity_id: str, workspace: str | None = None) -> DataFrame:
    return in_workspace(entities, workspace).filter(F.col("id") == entity_id)


def query_entities(entities: DataFrame, entity_type: str | None = None,
                   filters: dict[str, str] | None = None, limit: int | None = None,
                   workspace: str | None = None) -> DataFrame:
    """Entities by type and property equality, lowest ids first."""
    rows = in_workspace(entities, workspace)
    if entity_type is not None:
        rows = rows.filter(F.col("type") == entity_type)
    for key, value in (filters or {}).items():
        rows = rows.filter(F.element_at("props", F.lit(key)) == F.lit(str(value)))
    return rows if limit is None else rows.orderBy("workspace_id", "id").limit(limit)


def search_entities(entities: DataFrame, text: str, limit: int | None = None,
                    workspace: str | None = None) -> DataFrame:
    """The entity with that id, else entities whose text holds it, ignoring case; ``limit`` takes the
    lowest ids. Whether there is an exact hit is a scalar aggregate beside the scan."""
    needle = F.lit(text.lower())
    rows = in_workspace(entities, workspace)
    held: Column = F.exists(F.map_values("props"), lambda v: F.lower(v).contains(needle))
    for c in ("id", "type", "workspace_id"):
        held = held | F.lower(c).contains(needle)
    hit = rows.filter(F.col("id") == text)
    hits = hit.agg(F.count("*")).scalar()
    found = hit.unionByName(rows.filter(held & (F.col("id") != text) & (hits == 0)))
    return found if limit is None else found.orderBy("workspace_id", "id").limit(limit)


def query_relations(relations: DataFrame, relation_type: str | None = None,
                    source_id: str | None = None, target_id: str | None = None,
                    limit: int | None = None, workspace: str | None = None) -> DataFrame:
    rows = in_workspace(relations, workspace)
    for column, value in (("type", relation_type), ("source_id", source_id),
                          ("target_id", target_id)):
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    if limit is None:
        return rows
    return rows.orderBy("workspace_id", "source_id", "target_id", "type").limit(limit)


def neighbors(entities: DataFrame, relations: DataFrame, ids: DataFrame | list[str] | None = None,
              types: list[str] | None = None, direction: str = "both",
              workspace: str | None = None) -> DataFrame:
    """``node, id, type, props, relation, direction`` for every neighbour that has an entity row.

    ``ids`` limits the nodes asked for; None asks for all of them. Nodes given as a list reach the
    relation scan as a filter, before the edges are doubled.
    """
    edges = in_workspace(relations, workspace)
    if types:
        edges = edges.filter(F.col("type").isin(types))

    def oriented(node: str, other: str, name: str) -> DataFrame:
        rows = edges.filter(F.col(node).isin(ids)) if isinstance(ids, list) else edges
        return rows.select("workspace_id", F.col(node).alias("node"), F.col(other).alias("id"),
                           F.col("type").alias("relation"), F.lit(name).alias("direction"))

    parts = []
    if direction in ("out", "both"):
        parts.append(oriented("source_id", "target_id", "out"))
    if direction in ("in", "both"):
        parts.append(oriented("target_id", "source_id", "in"))
    if not parts:
        raise ValueError(f"unknown direction {direction!r}")
    steps = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if isinstance(ids, DataFrame):
        steps = steps.join(ids.select(F.col("id").alias("node")).distinct(), "node", "left_semi")
    known = in_workspace(entities, workspace).select("workspace_id", "id", "type", "props")
    return steps.join(known, ["workspace_id", "id"]).select(
        "workspace_id", "node", "id", "type", "props", "relation", "direction")


def _known(entities: DataFrame, workspace: str | None, node: str) -> DataFrame:
    return in_workspace(entities, workspace).select("workspace_id", F.col("id").alias(node)).distinct()


def shortest_paths(relations: DataFrame, pairs: DataFrame, max_depth: int = 3,
                   entities: DataFrame | None = None) -> DataFrame:
    """Shortest directed path of every ``(workspace_id, src, dst)`` pair, at most ``max_depth``
    nodes long: ``workspace_id, src, dst, path, length``. Ties go to the smallest path.

    A breadth-first search from both ends. A step widens the smaller frontier by one edge: forward all nodes
    that sources reach, or backward all that reach targets, one smallest path each, without those seen before.
    Pairs whose ends meet in a node have their path, as no shorter step let them meet; they leave the search, and
    so do ends without open pairs. Frontiers and open pairs are written at each step, so that no plan
    holds the steps before.
    """
    ws = "workspace_id"
    edges = relations.filter("source_id <> target_id").select(ws, "source_id", "target_id")
    open_pairs = materialize(pairs.select(ws, "src", "dst").distinct())
    same = open_pairs.filter("src = dst").select(ws, "src", "dst", F.array("src").alias("path"))
    ends = {}
    for side in ("src", "dst"):
        first = open_pairs.filter("src <> dst").select(ws, side).distinct().select(
            ws, F.col(side).alias("end"), F.col(side).alias("node"), F.array(side).alias("path"))
        front = materialize(first)
        ends[side] = {"front": front, "seen": front.select(ws, "end", "node"), "size": front.count()}
    open_pairs = open_pairs.filter("src <> dst")
    # all nodes but the source have to be known; rows that share an id fall together with their paths
    known = None if entities is None else entities.select(ws, F.col("id").alias("node"))
    walked = 0

    def widened(side: str, front: DataFrame) -> DataFrame:
        if side == "src":
            step = front.join(edges, [F.col("node") == F.col("source_id"), front[ws] == edges[ws]]).select(
                front[ws], "end", F.col("target_id").alias("node"), F.concat("path", F.array("target_id")).alias("path"))
            return step if known is None else step.join(known, [ws, "node"]).select(ws, "end", "node", "path")
        if known is not None:
            front = front.join(known, [ws, "node"]).select(ws, "end", "node", "path")
        back = edges.toDF(ws, "before", "node")
        return front.join(back, [ws, "node"]).select(
            ws, "end", F.col("before").alias("node"), F.concat(F.array("before"), "path").alias("path"))

    found = [same]
    for length in range(1, max_depth):
        side = min(("dst", "src"), key=lambda s: ends[s]["size"])
        end = ends[side]
        step = widened(side, end["front"]).groupBy(ws, "end", "node").agg(F.min("path").alias("path"))
        end["front"] = materialize(step.join(end["seen"], [ws, "end", "node"], "left_anti"))
        end["seen"] = end["seen"].unionByName(end["front"].select(ws, "end", "node"))
        end["size"] = end["front"].count()
        if not end["size"]:
            break
        walked += side == "src"
        begun = (open_pairs.join(ends["src"]["front"].select(ws, F.col("end").alias("src"), "node", F.col("path").alias("head")),
                                 [ws, "src"]) if walked else open_pairs.withColumns({"node": F.col("src"), "head": F.array("src")}))
        ended = ends["dst"]["front"].select(ws, F.col("end").alias("dst"), "node", F.col("path").alias("tail"))
        met = begun.join(ended, [ws, "dst", "node"]).groupBy(ws, "src", "dst").agg(
            F.min(F.concat("head", F.slice("tail", 2, max_depth))).alias("path"))
        if length == max_depth - 1:
            found.append(met)
            break
        met = materialize(met)
        if met.isEmpty():
            continue
        found.append(met)
        open_pairs = materialize(open_pairs.join(met, [ws, "src", "dst"], "left_anti"))
        if open_pairs.isEmpty():
            break
        for s in ends:
            left = open_pairs.select(ws, F.col(s).alias("end")).distinct()
            ends[s]["front"] = ends[s]["front"].join(left, [ws, "end"], "left_semi")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.select(ws, "src", "dst", "path", (F.size("path") - 1).alias("length"))


def shortest_path(relations: DataFrame, src: str, dst: str, max_depth: int = 3,
                  entities: DataFrame | None = None, workspace: str = "default") -> DataFrame:
    """``path, length`` of one shortest path, or no row."""
    one = relations.sparkSession.range(1).select(
        F.lit(workspace).alias("workspace_id"), F.lit(src).alias("src"), F.lit(dst).alias("dst"))
    return shortest_paths(in_workspace(relations, workspace), one, max_depth,
                          entities).select("path", "length")


def all_paths(relations: DataFrame, sources: DataFrame | list[str], max_depth: int = 3,
              limit: int | None = None, entities: DataFrame | None = None,
              workspace: str | None = None) -> DataFrame:
    """All simple directed paths from the sources with up to ``max_depth`` nodes, shortest first.

    Every level but the last is written to the scratch folder. Sources given as a list are few: edges meet the
    frontier first, and parallel ones are merged behind the join."""
    edges = in_workspace(relations, workspace).select("workspace_id", "source_id", "target_id")
    few = isinstance(sources, list)
    if not few:
        edges = edges.distinct()
    if entities is not None:
        edges = edges.join(_known(entities, workspace, "target_id"), ["workspace_id", "target_id"], "left_semi")
    start = edges.filter(F.col("source_id").isin(sources)) if few else edges.join(
        sources.select("workspace_id", F.col("src").alias("source_id")).distinct(),
        ["workspace_id", "source_id"], "left_semi")
    frontier = start.filter((F.col("source_id") != F.col("target_id")) & F.lit(max_depth > 1)).select(
        "workspace_id", F.col("source_id").alias("src"),
        F.array("source_id", "target_id").alias("path"))
    def level(paths: DataFrame, nodes: int) -> DataFrame:
        paths = paths.distinct() if few else paths
        return materialize(paths) if nodes < max_depth else paths

    levels = [level(frontier, 2)]
    for depth in range(2, max_depth):
        longer = (
            levels[-1].withColumn("_at", F.element_at("path", -1))
            .join(edges.withColumnRenamed("source_id", "_at"), ["workspace_id", "_at"])
            .filter(~F.array_contains("path", F.col("target_id")))
            .select("workspace_id", "src",
                    F.concat("path", F.array("target_id")).alias("path")))
        levels.append(level(longer, depth + 1))
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    found = found.withColumn("length", F.size("path") - 1)
    if limit is not None:
        found = found.orderBy("length", "path", "workspace_id").limit(limit)
    return found


def graph_stats(entities: DataFrame, relations: DataFrame,
                workspace: str | None = None) -> DataFrame:
    """Per workspace: nodes (endpoints without an entity row included), edges as distinct end
    pairs, relations, and the number of entity and relation types."""
    ent, rel = in_workspace(entities, workspace), in_workspace(relations, workspace)
    nodes = ent.select("workspace_id", "id").unionByName(rel.select(
        "workspace_id", F.explode(F.array("source_id", "target_id")).alias("id")))
    parts = [
        nodes.distinct().groupBy("workspace_id").agg(F.count("*").alias("nodes")),
        rel.select("workspace_id", "source_id", "target_id").distinct()
        .groupBy("workspace_id").agg(F.count("*").alias("edges")),
        rel.groupBy("workspace_id").agg(F.count("*").alias("relations"),
                                        F.count_distinct("type").alias("relation_types")),
        ent.groupBy("workspace_id").agg(F.count_distinct("type").alias("entity_types")),
    ]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    names = ["nodes", "edges", "relations", "entity_types", "relation_types"]
    return stacked.groupBy("workspace_id").agg(
        *[F.coalesce(F.max(n), F.lit(0)).alias(n) for n in names])


def list_types(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Distinct types per workspace, ``kind`` telling entities from relations."""
    return entities.select("workspace_id", F.lit("entity").alias("kind"), "type").unionByName(
        relations.select("workspace_id", F.lit("relation").alias("kind"), "type")).distinct()


def graph_query(entities: DataFrame, relations: DataFrame, text: str, kind: str = "entity",
                workspace: str = "default", max_depth: int = 3,
                limit: int | None = None) -> DataFrame:
    """Route a query to the entity, relation, neighbor or path operator."""
    if kind == "entity":
        return search_entities(entities, text, limit, workspace)
    if kind == "relation":
        return query_relations(relations, text, limit=limit, workspace=workspace)
    if kind == "neighbor":
        return neighbors(entities, relations, [text], workspace=workspace)
    if kind == "path":
        return all_paths(relations, [text], max_depth, limit, entities, workspace)
    raise ValueError(f"unknown query kind {kind!r}")
