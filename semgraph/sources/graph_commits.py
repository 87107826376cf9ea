"""Graph tables kept as commits: all tables change together, and a commit writes only what changes.

Under one path, each table has a folder per commit (partitioned by workspace), and ``commits`` holds one small
file per commit. That file is written last, as a single task's output that appears by one rename, so a run that
dies before leaves files that no reader lists. A commit may also name rows to drop by key; reading leaves
out rows whose key a later commit dropped, and ``compact`` writes the live rows as one commit.

Writers of different workspaces may run at once. Writers of one workspace, and ``compact``, must follow
each other.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semgraph.functions.values import map_fingerprint

KEYS = {
    "entities": ["workspace_id", "id"],
    "relations": ["workspace_id", "source_id", "target_id", "type"],
    "fingerprints": ["workspace_id", "fingerprint"],
}
LOG = "commit string, number long, replaces array<string>, schemas map<string,string>, gone array<string>"


def live_commits(spark: SparkSession, path: str) -> list[Row]:
    """Commits that make up the graph, oldest first; empty where nothing was committed."""
    try:
        log = spark.read.schema(LOG).json(f"{path.rstrip('/')}/commits").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    replaced = {name for c in log for name in c["replaces"] or []}
    return sorted((c for c in log if c["commit"] not in replaced), key=lambda c: c["commit"])


def commit(spark: SparkSession, path: str, tables: dict[str, DataFrame],
           gone: dict[str, DataFrame] | None = None, replaces: list[str] | None = None) -> str:
    """Add rows to the tables and drop the keys in ``gone``, all at once; returns the commit's name.

    Dropped keys concern earlier commits only, so replacing a row is its key in ``gone`` and the new row.
    ``replaces`` names commits whose rows this one holds.
    """
    path, gone = path.rstrip("/"), gone or {}
    number = 1 + max((c["number"] for c in live_commits(spark, path)), default=0)
    name = f"{number:012d}-{uuid.uuid4().hex}"
    for table, rows in tables.items():
        rows.write.partitionBy("workspace_id").parquet(f"{path}/{table}/commit={name}")
    for table, keys in gone.items():
        keys.select(*KEYS[table]).write.parquet(f"{path}/gone_{table}/commit={name}")
    entry = Row(name, number, replaces or [], {t: rows.schema.json() for t, rows in tables.items()}, list(gone))
    spark.createDataFrame([entry], LOG).coalesce(1).write.mode("append").json(f"{path}/commits")
    return name


def _rows(spark: SparkSession, path: str, folder: str, commits: list[Row], schema: T.StructType) -> DataFrame:
    folders = [f"{path}/{folder}/commit={c['commit']}" for c in commits]
    whole = T.StructType([*schema.fields, T.StructField("commit", T.StringType())])
    return spark.read.schema(whole).option("basePath", f"{path}/{folder}").parquet(*folders)


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame | None:
    """Live rows of a table, None where no commit holds it; a filter on ``workspace_id`` prunes folders."""
    path, keys, commits = path.rstrip("/"), KEYS[table], live_commits(spark, path)
    holding = [c for c in commits if table in c["schemas"]]
    if not holding:
        return None
    fields = {f.name: f for c in holding for f in T.StructType.fromJson(json.loads(c["schemas"][table])).fields}
    schema = T.StructType(list(fields.values()))
    rows = _rows(spark, path, table, holding, schema)
    dropping = [c for c in commits if table in c["gone"]]
    if dropping:
        of_keys = T.StructType([fields[k] for k in keys])
        until = _rows(spark, path, f"gone_{table}", dropping, of_keys).groupBy(*keys).agg(F.max("commit").alias("_until"))
        until = until.select("_until", *[F.col(k).alias(f"_{k}") for k in keys])
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
        rows = rows.join(until, same & (F.col("commit") < F.col("_until")), "left_anti")
    return rows.select(*schema.names)


def read_commits(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entities and relations as of the last commit."""
    tables = [read_table(spark, path, name) for name in ("entities", "relations")]
    if any(rows is None for rows in tables):
        raise ValueError(f"no graph was committed under {path}")
    return tables[0], tables[1]


def remove_entities(spark: SparkSession, path: str, ids: DataFrame) -> str:
    """Commit the removal of entities (``workspace_id, id``), of all relations that touch them and of their
    fingerprints, so that a later ingest may bring them back."""
    entities, relations = read_commits(spark, path)
    ids = ids.select("workspace_id", "id").distinct()
    out = entities.join(ids, ["workspace_id", "id"], "left_semi")
    touching = [relations.join(ids.withColumnRenamed("id", end), ["workspace_id", end], "left_semi").select(*KEYS["relations"])
                for end in ("source_id", "target_id")]
    prints = out.select("workspace_id", map_fingerprint(F.col("props")).alias("fingerprint"))
    return commit(spark, path, {}, {"entities": out, "relations": touching[0].unionByName(touching[1]),
                                    "fingerprints": prints})


def compact(spark: SparkSession, path: str) -> str | None:
    """Write the live rows as one commit in place of all; None where there is at most one. Files of
    replaced commits stay for readers that began before."""
    names = [c["commit"] for c in live_commits(spark, path)]
    if len(names) < 2:
        return None
    tables = {t: read_table(spark, path, t) for t in KEYS}
    return commit(spark, path, {t: rows for t, rows in tables.items() if rows is not None}, replaces=names)
