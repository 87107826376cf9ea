"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(app_name: str = "semgraph", master: str | None = None,
                conf: dict[str, str] | None = None) -> SparkSession:
    """Session with the settings the operators are planned for.

    AQE coalesces small shuffle partitions and splits skewed join partitions, so the initial
    partition number can stay high on a cluster. UTC keeps timestamps comparable between engines.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf or {})
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: ``spark.checkpoint.dir`` where the session names one.

    Only a local session may fall back to a temporary folder; on a cluster the executors would not
    see it, so a missing setting is an error there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    configured = tempfile.mkdtemp(prefix="semgraph-")
    spark.conf.set("spark.checkpoint.dir", configured)
    return configured


#: Bytes that an open Parquet file holds before it writes them, where a task has many files open.
BLOCK = 16 << 20


@contextmanager
def unsorted_writes(spark: SparkSession, files: int = 64) -> Iterator[None]:
    """Partitioned writes inside keep up to ``files`` files a task open instead of sorting whole rows by folder; a
    task with more folders sorts the rest."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name, None)
    spark.conf.set(name, files)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts the lineage of iterative plans; the result survives lost executors, is computed once and
    keeps column pruning for the next step.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/semgraph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
