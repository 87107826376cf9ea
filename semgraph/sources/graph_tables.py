"""Graph tables on disk, partitioned by workspace."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semgraph.session import BLOCK, unsorted_writes


def write_graph(entities: DataFrame, relations: DataFrame, path: str, mode: str = "overwrite",
                files_per_workspace: int | None = None, only_given: bool = False) -> None:
    """Write both tables under ``path``.

    By default tasks write the workspaces they hold, without a shuffle. ``files_per_workspace``
    spreads each workspace over that many writers by id hash, so that a large workspace is not one
    task's work and a small one is not thousands of files. With ``only_given``, overwriting replaces
    the workspaces that the tables hold and leaves others.
    """
    for df, name, ident in ((entities, "entities", "id"), (relations, "relations", "source_id")):
        if files_per_workspace:
            salt = F.pmod(F.xxhash64(ident), F.lit(files_per_workspace))
            df = df.withColumn("_salt", salt).repartition("workspace_id", "_salt").drop("_salt")
        writer = df.write.option("partitionOverwriteMode", "dynamic" if only_given else "static")
        with unsorted_writes(df.sparkSession):
            writer.option("parquet.block.size", BLOCK).mode(mode).partitionBy("workspace_id").parquet(f"{path.rstrip('/')}/{name}")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entities and relations; a filter on ``workspace_id`` prunes directories."""
    tables = []
    for name in ("entities", "relations"):
        df = spark.read.parquet(f"{path.rstrip('/')}/{name}")
        tables.append(df.withColumn("workspace_id", F.col("workspace_id").cast("string")))
    return tables[0], tables[1]
