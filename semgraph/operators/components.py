"""Connected components of many graphs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semgraph.session import materialize


def component_labels(edges: DataFrame, keys: list[str] | None = None,
                     max_rounds: int = 100) -> DataFrame:
    """``keys, node, component`` of the nodes of undirected ``edges(keys, u, v)``; the component is
    its smallest node. Nodes are of any orderable type.

    Alternating large-star / small-star rounds (Kiveris et al., 2014): every round replaces the
    edges by edges to the smallest neighbour seen, so long chains take logarithmically many rounds.
    A round is two ``min`` aggregates, combined map-side, and two joins against one row per node,
    whose large nodes adaptive execution splits. Rounds write to the shared scratch folder. The
    loop ends when the edges are stars; only that count reaches the driver.
    """
    keys = keys or []
    key_u = [*keys, "u"]

    def large_star(e: DataFrame) -> DataFrame:
        both = e.select(*key_u, "v").unionByName(
            e.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*key_u).agg(F.min(F.least("u", "v")).alias("_low"))
        return (both.filter("v > u").join(low, key_u)
                .select(*keys, F.col("v").alias("u"), F.col("_low").alias("v")))

    def small_star(e: DataFrame) -> DataFrame:
        down = e.select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = down.groupBy(*key_u).agg(F.min("v").alias("_low"))
        moved = down.join(low, key_u).select(*keys, F.inline(F.array(
            F.struct(F.col("u").alias("u"), F.col("_low").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("_low").alias("v")))))
        return moved.filter("u <> v").distinct()

    def unsettled(e: DataFrame) -> int:
        """Nodes that are both a centre and a leaf, or a leaf of two centres."""
        roles = e.select(*keys, F.inline(F.array(
            F.struct(F.col("u").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")),
            F.struct(F.col("v").alias("node"), F.lit(0).alias("leaf"), F.lit(1).alias("centre")))))
        per_node = roles.groupBy(*keys, "node").agg(F.sum("leaf").alias("leaf"),
                                                    F.max("centre").alias("centre"))
        return per_node.filter("leaf > 1 or (leaf > 0 and centre > 0)").count()

    current = materialize(edges.filter("u <> v").select(
        *keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _round in range(max_rounds):
        if not unsettled(current):
            break
        current = materialize(small_star(large_star(current)))
    else:
        raise RuntimeError("components did not settle; allow more rounds")
    centres = current.select(*keys, F.col("v").alias("node"), F.col("v").alias("component"))
    leaves = current.select(*keys, F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(centres.distinct())


def connected_components(nodes: DataFrame, edges: DataFrame, keys: list[str],
                         max_rounds: int = 100) -> DataFrame:
    """``keys, node, component`` for ``nodes(keys, node)`` and undirected ``edges(keys, u, v)``;
    a node without edges is its own component."""
    labels = component_labels(edges, keys, max_rounds)
    return nodes.join(labels, [*keys, "node"], "left").select(
        *keys, "node", F.coalesce("component", "node").alias("component"))
