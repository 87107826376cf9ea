"""Shared pieces of the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semgraph.session import materialize

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    """Queries and check SQL by name."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(query: Query) -> Query:
            self.queries[name] = query
            if sql is not None:
                self.sql[name] = sql
            return query
        return register


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{table}.parquet")


_STORED: dict[tuple[str, str, str], DataFrame] = {}


def stored(spark: SparkSession, sf: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table, written once per application and read back from then on."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STORED:
        _STORED[key] = materialize(build())
    return _STORED[key]


def joined(items: Column) -> Column:
    """Array as text, for comparison between engines."""
    return F.array_join(items, ",")


def props_text(col: str = "props") -> Column:
    """Property map as ``k=v`` pairs in key order."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(col)),
                                    lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
