"""Usage analytics over a log of model calls."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

# USD per million input and output tokens (fixed values).
PRICES = {
    "gpt-4": (30.0, 60.0),
    "gpt-4-turbo": (10.0, 30.0),
    "gpt-4o": (5.0, 15.0),
    "gpt-3.5-turbo": (0.5, 1.5),
    "gpt-4o-mini": (0.15, 0.6),
    "claude-3-opus": (15.0, 75.0),
    "claude-3-sonnet": (3.0, 15.0),
    "claude-3-haiku": (0.25, 1.25),
}
DEFAULT_PRICE = (0.5, 1.5)

# Model per task complexity: preferring the cheap one, and not (fixed values).
ROUTES = {"simple": ("gpt-4o-mini", "gpt-3.5-turbo"), "medium": ("gpt-3.5-turbo", "gpt-4o"),
          "other": ("gpt-4o", "gpt-4-turbo")}

SAVED_PER_HIT = 0.01
CACHE_TTL = 3600


def request_key(model: Column, system: Column, prompt: Column) -> Column:
    """SHA-256 of ``model:system:prompt``; a missing system prompt is empty."""
    empty = F.lit("")
    return F.sha2(F.concat(F.coalesce(model, empty), F.lit(":"), F.coalesce(system, empty),
                           F.lit(":"), F.coalesce(prompt, empty)), 256)


def request_cost(df: DataFrame, prices: dict[str, tuple[float, float]] | None = None,
                 default: tuple[float, float] = DEFAULT_PRICE) -> DataFrame:
    """Add ``cost`` from ``model, input_tokens, output_tokens``; the price list is a constant map
    of the plan, so no join is needed. An unknown model costs the default price."""
    table = PRICES if prices is None else prices

    def price(at: int) -> Column:
        known = F.create_map(*[F.lit(x) for m, p in table.items() for x in (m, float(p[at]))])
        return F.coalesce(F.element_at(known, F.col("model")), F.lit(float(default[at])))

    return df.withColumn("cost", F.col("input_tokens") / 1e6 * price(0)
                         + F.col("output_tokens") / 1e6 * price(1))


def _micros(df: DataFrame, ts: str) -> Column:
    """Microseconds since 1970 of either timestamp type."""
    if dict(df.dtypes)[ts] == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(ts))
    return F.unix_micros(ts)


def _instant(df: DataFrame, ts: str, micros: str) -> Column:
    if dict(df.dtypes)[ts] == "timestamp_ntz":
        return F.timestamp_add("MICROSECOND", F.col(micros), F.lit("1970-01-01").cast("timestamp_ntz"))
    return F.timestamp_micros(micros)


CELL = 16


def _grouped(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Rows of each run of equal ``names``, runs that cross batches put together."""
    held: list[pd.DataFrame] = []

    def whole() -> tuple[tuple, pd.DataFrame]:
        return tuple(None if pd.isna(v) else v for v in held[0][names].iloc[0]), pd.concat(held)

    for batch in batches:
        frame = batch.to_pandas()
        codes = np.zeros(len(frame), bool)
        for name in names:
            values = frame[name].to_numpy()
            codes[1:] |= (values[1:] != values[:-1]) & ~(pd.isna(values[1:]) & pd.isna(values[:-1]))
        cuts = np.flatnonzero(codes).tolist()
        for start, stop in zip([0, *cuts], [*cuts, len(frame)], strict=True):
            part = frame.iloc[start:stop]
            if start == stop:
                continue
            if held and start == 0 and all(
                    a == b or (pd.isna(a) and pd.isna(b)) for a, b in zip(part[names].iloc[0], held[0][names].iloc[0])):
                held.append(part)
                continue
            if held:
                yield whole()
            held = [part]
    if held:
        yield whole()


def _table(columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def miss_instants(df: DataFrame, ttl: float = CACHE_TTL, key: str = "request_key",
                  ts: str = "ts", cell: int = CELL) -> DataFrame:
    """``key, ts`` of the requests that fill the cache: the first one, then each first request at
    least ``ttl`` seconds after the previous filling. Requests without ``ts`` fill nothing; those without
    key share one.

    Each fill depends on the one before, but only through one number, the time from which the next request
    fills. So time is cut into cells of ``cell`` TTLs, and every cell of a key works out on its own what it makes of
    that number: for each request that may be its first to fill, the time that its last one leaves. Many starts
    soon run into the same fills, and equal results are kept once. One pass over these short lists, in order,
    gives each cell its start, and all cells find their fills at once. A task holds the distinct
    instants of one key and cell.
    """
    step = max(1, int(round(ttl * 1_000_000)))
    width = step * cell
    kind = df.select(key).schema[0].dataType
    arrow_key = pa.field("key", to_arrow_type(kind))
    instants = (df.select(F.col(key).alias("key"), _micros(df, ts).alias("at")).filter("at IS NOT NULL").distinct()
                .withColumn("cell", F.floor(F.col("at") / width)))
    leaves = pa.schema([arrow_key, ("cell", pa.int64()), ("at", pa.int64()), ("leaves", pa.int64())])
    starts = pa.schema([arrow_key, ("cell", pa.int64()), ("start", pa.int64())])
    fills = pa.schema([arrow_key, ("at", pa.int64())])
    sql = kind.simpleString()

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (of, number), group in _grouped(batches, ["key", "cell"]):
            times = group["at"].to_numpy()
            last = np.arange(min(len(times), int(np.searchsorted(times, int(number) * width + step)) + 1))
            moving = last
            while len(moving):
                following = np.searchsorted(times, times[last[moving]] + step)
                inside = following < len(times)
                moving = moving[inside]
                last[moving] = following[inside]
            left = times[last] + step
            kept = np.append(left[1:] != left[:-1], True)
            count = int(kept.sum())
            yield _table({"key": [of] * count, "cell": [int(number)] * count, "at": times[:len(kept)][kept], "leaves": left[kept]}, leaves)

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, start = None, -2**63
        for (of, number), group in _grouped(batches, ["key", "cell"]):
            if current != (of,):
                current, start = (of,), -2**63
            yield _table({"key": [of], "cell": [int(number)], "start": [start]}, starts)
            at = int(np.searchsorted(group["at"].to_numpy(), start))
            if at < len(group):
                start = int(group["leaves"].iloc[at])

    def filling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (of, _number), group in _grouped(batches, ["key", "cell"]):
            times, found = group["at"].to_numpy()[1:], []
            at = int(np.searchsorted(times, int(group["start"].iloc[0])))
            while at < len(times):
                found.append(int(times[at]))
                at = int(np.searchsorted(times, found[-1] + step))
            yield _table({"key": [of] * len(found), "at": found}, fills)

    def by_cell(rows: DataFrame) -> DataFrame:
        return rows.repartition("key", "cell").sortWithinPartitions("key", "cell", "at")

    short = by_cell(instants).mapInArrow(results, f"key {sql}, cell bigint, at bigint, leaves bigint")
    begun = (short.repartition("key").sortWithinPartitions("key", "cell", "at")
             .mapInArrow(chained, f"key {sql}, cell bigint, start bigint"))
    # the start of a cell comes before all instants
    both = instants.withColumn("start", F.lit(0).cast("long")).unionByName(begun.withColumn("at", F.lit(-2**63))).select(
        "key", "cell", "at", "start")
    found = by_cell(both).mapInArrow(filling, f"key {sql}, at bigint")
    return found.select(F.col("key").alias(key), _instant(df, ts, "at").alias(ts))


def label_cache_hits(df: DataFrame, ttl: float = CACHE_TTL, key: str = "request_key",
                     ts: str = "ts", tie: str = "request_id") -> DataFrame:
    """Add ``cached``: a request is a hit unless it fills the cache. Of requests at one instant
    the smallest ``tie`` fills. Without ``ts`` it is null. The log itself stays in Spark; only the fills come
    back by join."""
    head = df.groupBy(F.col(key).alias("_key"), F.col(ts).alias("_ts")).agg(F.min(tie).alias("_tie"))
    fills = miss_instants(df, ttl, key, ts).select(F.col(key).alias("_fill_key"), F.col(ts).alias("_fill_ts"))
    misses = head.join(fills, F.col("_key").eqNullSafe(F.col("_fill_key")) & (F.col("_ts") == F.col("_fill_ts")), "left_semi")
    met = F.col(key).eqNullSafe(F.col("_key")) & (F.col(ts) == F.col("_ts")) & (F.col(tie) == F.col("_tie"))
    return (df.join(misses, met, "left")
            .withColumn("cached", F.when(F.col(ts).isNotNull(), F.col("_ts").isNull())).select(*df.columns, "cached"))


def usage_stats(df: DataFrame) -> DataFrame:
    """Requests, tokens and cost per model and in total (``model`` NULL), with the cache hit rate
    and estimated savings. Hits count as requests but cost nothing."""
    paid = ~F.col("cached")

    def when_paid(name: str) -> Column:
        return F.coalesce(F.sum(F.when(paid, F.col(name))), F.lit(0))

    return df.rollup("model").agg(
        F.count("*").alias("total_requests"), F.count_if("cached").alias("cached_requests"),
        when_paid("input_tokens").alias("total_tokens_input"),
        when_paid("output_tokens").alias("total_tokens_output"),
        when_paid("cost").alias("total_cost"),
        (F.count_if("cached") / F.count("*")).alias("cache_hit_rate"),
        (F.count_if("cached") * SAVED_PER_HIT).alias("estimated_savings"),
        F.grouping("model").alias("is_total"))


def route_model(complexity: Column, prefer_cheap: bool = True) -> Column:
    """Model for a task complexity."""
    at = 0 if prefer_cheap else 1
    return (F.when(complexity == "simple", ROUTES["simple"][at])
            .when(complexity == "medium", ROUTES["medium"][at]).otherwise(ROUTES["other"][at]))
