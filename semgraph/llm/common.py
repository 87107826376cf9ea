"""Column names, text access and registered queries shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\f\r"

Query = Callable[[SparkSession, str], DataFrame]


class Queries:
    """Queries of a module and the SQL that checks them, by name."""

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


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def free_name(taken: Iterable[str], base: str) -> str:
    """``base``, with underscores before it until no column of ``taken`` has that name."""
    lower = {name.lower() for name in taken}
    while base.lower() in lower:
        base = f"_{base}"
    return base


def texts_of(column: pa.Array, rows: int = 256) -> Iterator[str | None]:
    """The values of a column of texts; only a few are Python strings at a time."""
    for at in range(0, len(column), rows):
        yield from column.slice(at, rows).to_pylist()


def ascii_lower(text: Column) -> Column:
    """Only A-Z in lower case, as the contracts of words and lines ask; other letters stay.

    ``lower`` has a fast path for pure ASCII, which is the same there."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def digest(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, lowercase hex."""
    return F.sha2(text.cast("binary"), 256)
