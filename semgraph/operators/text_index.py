"""Text search through posting lists of three-letter runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semgraph.operators.graph_query import in_workspace, search_entities

GRAM = 3


def _grams(text: Column) -> Column:
    """Runs of three characters of a lower-cased text, in time proportional to its length."""
    letters = F.split(F.lower(text), "")
    return F.transform(F.slice(letters, 1, F.greatest(F.size(letters) - (GRAM - 1), F.lit(0))),
                       lambda c, i: F.concat(c, F.get(letters, i + 1), F.get(letters, i + 2)))


def write_text_index(entities: DataFrame, path: str) -> None:
    """Store ``gram, workspace_id, id`` for every run of three characters in an entity's id, type, workspace or
    property values, and the number of entities per gram.

    Files are ranges of grams, so a search reads the row groups of its grams; a gram that many entities hold
    spans several files, as ranges go on by a hash of the id.
    """
    path = path.rstrip("/")
    values = F.concat(F.array("id", "type", "workspace_id"), F.coalesce(F.map_values("props"), F.array().cast("array<string>")))
    held = F.flatten(F.transform(F.filter(values, lambda v: v.isNotNull()), _grams))
    postings = entities.select("workspace_id", "id", F.explode(F.array_distinct(held)).alias("gram"))
    (postings.repartitionByRange(F.col("gram"), F.xxhash64("id")).sortWithinPartitions("gram")
     .write.parquet(f"{path}/postings"))
    entities.sparkSession.read.parquet(f"{path}/postings").groupBy("gram").agg(F.count("*").alias("n")) \
        .sort("gram").write.parquet(f"{path}/counts")


def candidates(spark: SparkSession, path: str, text: str, grams: int = 3) -> DataFrame | None:
    """``workspace_id, id`` of entities that hold the ``grams`` rarest runs of the text, so all that can hold the
    text; None for a text too short to have any."""
    path, needle = path.rstrip("/"), text.lower()
    runs = sorted({needle[i:i + GRAM] for i in range(len(needle) - GRAM + 1)})
    if not runs:
        return None
    counted = spark.read.parquet(f"{path}/counts").filter(F.col("gram").isin(runs)).orderBy("n", "gram").collect()
    postings = spark.read.parquet(f"{path}/postings")
    if len(counted) < len(runs):
        return postings.select("workspace_id", "id").limit(0)
    rarest = [r["gram"] for r in counted[:grams]]
    found = postings.filter(F.col("gram").isin(rarest)).groupBy("workspace_id", "id").agg(F.count_distinct("gram").alias("n"))
    return found.filter(F.col("n") == len(rarest)).select("workspace_id", "id")


def search_indexed(entities: DataFrame, path: str, text: str, limit: int | None = None,
                   workspace: str | None = None, grams: int = 3) -> DataFrame:
    """As ``search_entities``, among the candidates of an index of the same entities; texts of fewer than three
    characters are searched for without it."""
    found = candidates(entities.sparkSession, path, text, grams)
    if found is not None:
        found = in_workspace(found, workspace).toDF("_workspace", "_id")
        same = F.col("id").eqNullSafe(F.col("_id")) & F.col("workspace_id").eqNullSafe(F.col("_workspace"))
        entities = in_workspace(entities, workspace).join(found, same, "left_semi")
    return search_entities(entities, text, limit, workspace)
