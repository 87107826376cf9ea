"""Column helpers for dynamically typed record values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space as a dynamic-language string strip understands it (fixed values).
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE_PATTERN = (
    r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)

# Keys of a record that carry bookkeeping rather than properties (fixed values).
RESERVED_KEYS = ("type", "id", "source", "chunk_index", "total_chunks", "metadata")


def truthy(col: Column, data_type: T.DataType) -> Column:
    """Whether a value counts as present: not NULL, not empty, not zero, not false."""
    if isinstance(data_type, (T.StringType, T.VarcharType, T.CharType)):
        return col.isNotNull() & (col != F.lit(""))
    if isinstance(data_type, T.NumericType):
        return col.isNotNull() & (col != F.lit(0))
    if isinstance(data_type, T.BooleanType):
        return F.coalesce(col, F.lit(False))
    if isinstance(data_type, (T.ArrayType, T.MapType)):
        return col.isNotNull() & (F.size(col) > 0)
    if isinstance(data_type, T.BinaryType):
        return col.isNotNull() & (F.length(col) > 0)
    return col.isNotNull()


def as_text(col: Column, data_type: T.DataType) -> Column:
    """Text of a value; NULL stays NULL."""
    if isinstance(data_type, (T.StringType, T.VarcharType, T.CharType)):
        return col
    if isinstance(data_type, T.BooleanType):
        return F.when(col, F.lit("True")).when(~col, F.lit("False"))
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(col)
    return col.cast("string")


def strip(col: Column) -> Column:
    """Remove leading and trailing white space, Unicode spaces included."""
    return F.btrim(col, F.lit(SPACE_CHARS))


def map_of(pairs: dict[str, Column]) -> Column:
    """``map<string,string>`` of the given values without the NULL ones."""
    if not pairs:
        return F.expr("map_from_entries(cast(array() as array<struct<key:string,value:string>>))")
    flat: list[Column] = []
    for key, value in pairs.items():
        flat += [F.lit(key), value]
    return F.map_filter(F.create_map(*flat), lambda _k, v: v.isNotNull())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def map_last_wins(entries: Column) -> Column:
    """Map from key/value structs in which a later entry replaces an earlier one of the same key."""
    def last_ones(items: Column) -> Column:
        def is_last(entry: Column, index: Column) -> Column:
            rest = F.slice(items, index + 2, F.size(items))
            return ~F.exists(rest, lambda later: later["key"] == entry["key"])
        return F.filter(items, is_last)
    return F.map_from_entries(let(entries, last_ones))


def map_fingerprint(props: Column) -> Column:
    """md5 of a property map, blind to key order, letter case and outer white space."""
    pairs = F.transform(
        F.array_sort(F.map_entries(props)),
        lambda e: F.concat(e["key"], F.lit("\x1f"),
                           F.coalesce(strip(F.lower(e["value"])), F.lit("none"))),
    )
    return F.md5(F.array_join(pairs, "\x1e"))
