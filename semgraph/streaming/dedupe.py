"""Streaming entity de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semgraph.operators.graph_build import with_fingerprint


def stream_dedupe_entities(stream: DataFrame, ts: str | None = None,
                           within: str | None = None) -> DataFrame:
    """First entity per workspace and property fingerprint across micro-batches, in order of arrival.

    With ``ts`` and ``within`` (a delay such as ``"1 hour"``) the state is bounded by the watermark;
    without them every fingerprint is remembered for good.
    """
    marked = with_fingerprint(stream)
    keys = ["workspace_id", "fingerprint"]
    if ts and within:
        return marked.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys).drop("fingerprint")
    return marked.dropDuplicates(keys).drop("fingerprint")


def first_entities(entities: DataFrame, ts: str = "ts", gap: str = "1 hour", delay: str = "10 minutes",
                   order: tuple[str, ...] = ("seq", "id")) -> DataFrame:
    """Smallest entity by ``order`` of each run of copies, on a stream or a table, whatever the order of arrival.

    Copies have one workspace and property fingerprint; two that follow each other within ``gap`` belong to
    one run. Adds ``n_copies`` and ``last_ts``, the time of the run's last copy. On a stream a run comes out once
    the watermark, ``delay`` behind the latest ``ts``, has passed its end, and then leaves the state, which
    holds one row per open run. Later rows are dropped by the watermark, so ``delay`` must cover the
    disorder. With ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` copies are merged
    before the shuffle. Rows without ``ts`` are left out on both.
    """
    marked = with_fingerprint(entities).withColumn(ts, F.col(ts).cast("timestamp")).filter(F.col(ts).isNotNull())
    if entities.isStreaming:
        marked = marked.withWatermark(ts, delay)
    rest = [c for c in entities.columns if c != "workspace_id"]
    runs = marked.groupBy("workspace_id", "fingerprint", F.session_window(ts, gap).alias("run")).agg(
        F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*order)).alias("first"),
        F.count("*").alias("n_copies"), F.max(ts).alias("last_ts"))
    return runs.select("workspace_id", "first.*", "n_copies", "last_ts").select(*entities.columns, "n_copies", "last_ts")
