"""Streaming cache-hit labelling in event time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class _CacheState(StatefulProcessor):
    """Per key, requests wait in time slots until the watermark has passed a slot; then the slot is sorted and
    labelled. State: the waiting requests by slot, and when the cache was filled last, which a timer forgets
    after the TTL. A slot's requests are the most that is held in memory."""

    def __init__(self, ttl_seconds: float, ts: str, tie: str, slot_seconds: float):
        self._ttl = int(round(ttl_seconds * 1_000_000))
        self._slot = max(1, int(round(slot_seconds * 1000))) * 1000
        self._ts, self._tie = ts, tie

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._filled = handle.getValueState("filled", "us bigint")
        self._pieces = handle.getMapState("pieces", "slot bigint, piece bigint", "data binary")
        self._waiting = handle.getMapState("waiting", "slot bigint", "pieces bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            timeless = batch[self._ts].isna()
            if timeless.any():
                yield batch[timeless].assign(cached=None)
                batch = batch[~timeless]
            slots = self._micros(batch) // self._slot
            for slot in np.unique(slots).tolist():
                known = self._waiting.getValue((slot,))[0] if self._waiting.containsKey((slot,)) else 0
                self._pieces.updateValue((slot, known), (_packed(batch[slots == slot]),))
                self._waiting.updateValue((slot,), (known + 1,))
                if not known:
                    self._handle.registerTimer((slot + 1) * self._slot // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        filled = self._filled.get()[0] if self._filled.exists() else None
        before = filled
        for slot in sorted(s for (s,) in self._waiting.keys() if (s + 1) * self._slot <= now):
            pieces = self._waiting.getValue((slot,))[0]
            rows = pd.concat([_unpacked(self._pieces.getValue((slot, i))[0]) for i in range(pieces)], ignore_index=True)
            rows = rows.sort_values([self._ts, self._tie])
            hits = []
            for at in self._micros(rows).tolist():
                hit = filled is not None and at - filled < self._ttl
                hits.append(hit)
                filled = filled if hit else at
            yield rows.assign(cached=hits)
            for i in range(pieces):
                self._pieces.removeKey((slot, i))
            self._waiting.removeKey((slot,))
        if filled is not None and filled + self._ttl <= now:  # all timers stand at the end of a slot
            self._filled.clear()
        elif filled != before:
            self._filled.update((filled,))
            self._handle.registerTimer(-(-(filled + self._ttl) // self._slot) * self._slot // 1000)

    def _micros(self, rows: pd.DataFrame) -> np.ndarray:
        return rows[self._ts].astype("datetime64[us]").astype("int64").to_numpy()

    def close(self) -> None:
        pass


def _packed(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(data)).read_all().to_pandas()


def stream_label_cache_hits(stream: DataFrame, ttl: float = 3600, key: str = "request_key",
                            ts: str = "ts", tie: str = "request_id",
                            delay: str = "10 minutes", slot: float = 60) -> DataFrame:
    """Add ``cached`` to a stream of requests, as ``label_cache_hits`` does to a table.

    Requests count in the order of ``ts`` (then ``tie``), however they arrive: a request is held back until the
    watermark, ``delay`` behind the latest ``ts``, has passed its slot of ``slot`` seconds. Later ones are dropped
    by the watermark, so ``delay`` must cover the disorder of the stream, and the last requests come out once
    later ones of any key have moved the watermark. Requests without ``ts`` pass at once, ``cached`` null. Memory
    holds one slot of one key. Needs the RocksDB state store provider.
    """
    stream = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields]
    return stream.withWatermark(ts, delay).groupBy(key).transformWithStateInPandas(
        statefulProcessor=_CacheState(ttl, ts, tie, slot),
        outputStructType=", ".join([*columns, "cached boolean"]),
        outputMode="Append", timeMode="EventTime")
