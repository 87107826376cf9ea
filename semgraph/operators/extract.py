"""Rule-based entity and relation extraction from records.

Column names are metadata, so every name rule runs once on the driver; what is left per row is a
column expression. Entities are ``type, id, props``, relations ``type, source_id, target_id,
source_type, target_type, props``; ``props`` is ``map<string,string>``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semgraph.functions.values import RESERVED_KEYS, as_text, map_last_wins, map_of, truthy

# Column-name patterns and the entity type they suggest, first match wins (fixed values).
ENTITY_PATTERNS = {
    r"customer|client": "Customer",
    r"product|item": "Product",
    r"employee|staff|worker": "Employee",
    r"project|task": "Project",
    r"order|transaction|purchase": "Transaction",
    r"user|account": "User",
    r"company|organization|org": "Organization",
    r"location|address|city": "Location",
}

# Keywords looked for in all column names together when no column decides (fixed values).
KEYWORD_TYPES = (
    (("customer", "client"), "Customer"),
    (("product", "item"), "Product"),
    (("employee", "staff"), "Employee"),
    (("project", "task"), "Project"),
    (("order", "transaction"), "Transaction"),
)

# Order in which record keys are tried for an entity id (fixed values).
ID_KEYS = {
    "graph": ("id", "name", "title", "email", "url"),
    "fallback": ("name", "title", "email", "url", "id", "customer_id", "product_id",
                 "employee_id", "project_id"),
    "template": ("id", "name", "title", "email", "customer_id", "product_id", "employee_id",
                 "project_id"),
}

# Name parts that mark a foreign-key column (fixed values).
FK_PATTERNS = ("_id", "Id", "_ref")

RELATION_FIELDS = ["type", "source_id", "target_id", "source_type", "target_type"]


def infer_entity_types(columns: list[str]) -> dict[str, str]:
    """Column name → suggested entity type."""
    found = {}
    for name in columns:
        kind = next((t for p, t in ENTITY_PATTERNS.items() if re.search(p, name.lower())), None)
        if kind:
            found[name] = kind
    return found


def default_rules(columns: list[str]) -> dict:
    """Extraction rules that follow from the column names alone."""
    return {
        "relation_extraction": {"foreign_key_detection": list(FK_PATTERNS)},
        "entity_type_mapping": infer_entity_types(columns),
        "property_mapping": {c: c for c in columns},
    }


def merge_rules(rules: dict | None, columns: list[str]) -> dict:
    """Given rules completed by the defaults."""
    base = default_rules(columns)
    merged = dict(rules or {})
    merged["relation_extraction"] = {**base["relation_extraction"],
                                     **merged.get("relation_extraction", {})}
    for key in ("entity_type_mapping", "property_mapping"):
        merged[key] = merged.get(key) or base[key]
    return merged


def _types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def _given(df: DataFrame, name: str) -> Column:
    return truthy(F.col(f"`{name}`"), _types(df)[name])


def _text(df: DataFrame, name: str) -> Column:
    return as_text(F.col(f"`{name}`"), _types(df)[name])


def entity_type_col(df: DataFrame, rules: dict) -> Column:
    """First mapped column with a value, else a keyword of the column names, else ``Entity``."""
    names = " ".join(df.columns).lower()
    keyword = next((kind for words, kind in KEYWORD_TYPES if any(w in names for w in words)),
                   "Entity")
    mapped = [F.when(_given(df, c), F.lit(kind))
              for c, kind in rules.get("entity_type_mapping", {}).items() if c in df.columns]
    decided = F.coalesce(*mapped, F.lit("Entity"))
    return F.when(decided == "Entity", F.lit(keyword)).otherwise(decided)


def suggest_entity_type(keys: Column, ontology) -> Column:
    """Ontology entity sharing most property names with ``keys`` (an array column); the first
    declared wins a tie, NULL when nothing is shared."""
    scores = [
        F.struct(F.size(F.array_intersect(keys, F.array(*[F.lit(p) for p in props]))).alias("n"),
                 F.lit(-i).alias("first"), F.lit(name).alias("name"))
        for i, (name, props) in enumerate(ontology.property_names().items()) if props
    ]
    best = F.array_max(F.array(*scores))
    return F.when(best["n"] > 0, best["name"])


def _content_hash(df: DataFrame) -> Column:
    pairs = [F.concat(F.lit(f"{c}="), F.coalesce(_text(df, c), F.lit("None")))
             for c in sorted(df.columns)]
    return F.md5(F.concat_ws("\x1e", *pairs))


def entity_id_col(df: DataFrame, entity_type: Column, variant: str = "template",
                  id_keys: list[str] | None = None) -> Column:
    """``Type:value`` of the first id key with a value, else ``Type:column_value`` of the first
    column, else ``Type:hash``. The ``fallback`` variant takes a record's own id unprefixed."""
    def prefixed(text: Column) -> Column:
        return F.concat(entity_type, F.lit(":"), text)

    keys = [k for k in (id_keys or ID_KEYS[variant]) if k in df.columns]
    options = [F.when(_given(df, k), prefixed(_text(df, k))) for k in keys]
    if variant == "fallback" and "id" in df.columns:
        options.insert(0, F.when(_given(df, "id"), _text(df, "id")))
    if variant != "graph":
        columns = df.columns if variant == "template" else [
            c for c in df.columns if c not in RESERVED_KEYS]
        if columns and columns[0] not in RESERVED_KEYS:
            value = F.coalesce(_text(df, columns[0]), F.lit("None"))
            options.append(prefixed(F.concat(F.lit(f"{columns[0]}_"), value)))
    options.append(prefixed(_content_hash(df)))
    return F.coalesce(*options)


def project_properties(df: DataFrame, mapping: dict[str, str] | None = None,
                       skip: tuple[str, ...] = ()) -> Column:
    """Property map of the non-reserved columns, renamed by ``mapping``; NULL counts as absent."""
    kept = [c for c in df.columns if c not in RESERVED_KEYS and c not in skip]
    return map_of({(mapping or {}).get(c, c): _text(df, c) for c in kept})


def map_properties(entities: DataFrame, ontology) -> DataFrame:
    """Rename property keys to the ontology's spelling, ignoring case; unknown keys stay."""
    spellings: Column | None = None
    for name, props in ontology.property_names().items():
        table: dict[str, str] = {f"={p}": p for p in props}
        for p in props:
            table.setdefault(p.lower(), p)
        if table:
            of_type = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
            hit = F.col("type") == name
            spellings = F.when(hit, of_type) if spellings is None else spellings.when(hit, of_type)
    if spellings is None:
        return entities

    def rename(entry: Column) -> Column:
        key = F.coalesce(F.element_at(F.col("_spellings"), F.concat(F.lit("="), entry["key"])),
                         F.element_at(F.col("_spellings"), F.lower(entry["key"])), entry["key"])
        return F.struct(key.alias("key"), entry["value"].alias("value"))

    renamed = map_last_wins(F.transform(F.map_entries("props"), rename))
    return (entities.withColumn("_spellings", spellings).withColumn("props", renamed)
            .drop("_spellings"))


def _fk_columns(columns: list[str], variant: str, patterns: tuple[str, ...]) -> list[tuple]:
    """(column, target type, relation type, whether the value must be present).

    The target is named by what remains of the column without the foreign-key marks, the relation by
    the column's letters without marks.
    """
    marks = re.compile("|".join(map(re.escape, sorted(FK_PATTERNS, key=len, reverse=True))))
    fallback, found = variant == "fallback", []
    for name in columns:
        ends = name.endswith("_id")
        inside = "id" in name.lower() and name not in ("chunk_index", "total_chunks")
        if name.lower() == "id" and (not fallback or name == "id"):
            continue
        if not (ends or inside if fallback else any(p in name for p in patterns)):
            continue
        rest = re.sub("_id|Id", "", name) if fallback else marks.sub("", name).strip("_")
        letters = re.sub("_", "" , name.upper())
        relation = letters if fallback else letters.replace("ID", "")
        found.append((name, rest.title() or "Entity", f"HAS_{relation}", not (fallback and ends)))
    return found


def fk_relations(df: DataFrame, variant: str = "patterns",
                 patterns: tuple[str, ...] = FK_PATTERNS, entity_type: Column | None = None,
                 entity_id: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One relation per foreign-key column and row, all columns in one pass over the rows."""
    fallback = variant == "fallback"
    if entity_type is None:
        entity_type = (F.lit("Entity") if fallback
                       else entity_type_col(df, default_rules(df.columns)))
    if entity_id is None:
        entity_id = entity_id_col(df, entity_type, "fallback" if fallback else "template")
        keyed = [k for k in ID_KEYS["fallback"] if k in df.columns]
        if fallback and df.columns[0] in RESERVED_KEYS:
            given = F.lit(False)
            for k in keyed:
                given = given | _given(df, k)
            entity_id = F.when(given, entity_id)
    columns = [c for c in df.columns if c not in keep]
    edges = []
    for name, target, relation, must in _fk_columns(columns, variant, patterns):
        value = F.coalesce(_text(df, name), F.lit("None"))
        edge = F.struct(
            F.lit(relation).alias("type"), F.col("_source_id").alias("source_id"),
            F.concat(F.lit(f"{target}:"), value).alias("target_id"),
            F.col("_source_type").alias("source_type"),
            F.lit("Entity" if fallback else target).alias("target_type"))
        edges.append(F.when(_given(df, name), edge) if must else edge)
    ids = df.withColumn("_source_type", F.lit("Entity") if fallback else entity_type)
    ids = ids.withColumn("_source_id", entity_id)
    if not edges:
        empty = F.expr("cast(array() as array<struct<type:string,source_id:string,"
                       "target_id:string,source_type:string,target_type:string>>)")
        return ids.select(*keep, F.inline(empty)).withColumn("props", map_of({}))
    rows = ids.select(*keep, "_source_id", F.inline(F.array_compact(F.array(*edges))))
    return (rows.filter(F.col("_source_id").isNotNull()).drop("_source_id")
            .withColumn("props", map_of({})))


def nested_relations(df: DataFrame, col: str = "relations",
                     keep: tuple[str, ...] = ()) -> DataFrame:
    """Relations listed inside each record, as an array of structs or of string maps."""
    element = df.schema[col].dataType.elementType
    one = df.select(*keep, F.explode(col).alias("_r"))
    if isinstance(element, T.MapType):
        def value(key: str) -> Column:
            return F.element_at("_r", key)
        drop = F.array(*[F.lit(k) for k in
                         ("type", "source_id", "source", "target_id", "target")])
        props = F.map_filter("_r", lambda k, v: ~F.array_contains(drop, k) & v.isNotNull())
    else:
        def value(key: str) -> Column:
            return F.col(f"_r.`{key}`").cast("string") if key in element.names else \
                F.lit(None).cast("string")
        extra = [n for n in element.names
                 if n not in ("type", "source_id", "source", "target_id", "target")]
        props = map_of({n: as_text(F.col(f"_r.`{n}`"), element[n].dataType) for n in extra})

    def first_given(*keys: str) -> Column:
        return F.coalesce(*[F.when(value(k) != "", value(k)) for k in keys])

    return one.select(
        *keep,
        F.coalesce(value("type"), F.lit("RELATED_TO")).alias("type"),
        first_given("source_id", "source").alias("source_id"),
        first_given("target_id", "target").alias("target_id"),
        F.lit("Entity").alias("source_type"), F.lit("Entity").alias("target_type"),
        props.alias("props"))


def extract(df: DataFrame, rules: dict | None = None, variant: str = "template",
            id_keys: list[str] | None = None,
            keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of every record by rules; ``keep`` columns (workspace, sequence)
    ride along and are not properties."""
    data_columns = [c for c in df.columns if c not in keep]
    data = df.select(*data_columns)
    rules = merge_rules(rules, data_columns)
    kind = entity_type_col(data, rules)
    ident = entity_id_col(data, kind, variant, id_keys)
    entities = df.select(
        *keep, kind.alias("type"), ident.alias("id"),
        project_properties(data, rules["property_mapping"]).alias("props"))
    patterns = tuple(rules["relation_extraction"]["foreign_key_detection"])
    relations = fk_relations(df, patterns=patterns, entity_type=kind, entity_id=ident, keep=keep)
    return entities, relations


# ---- user functions ---------------------------------------------------------------------------

EXTRACTED = ("kind string, type string, id string, source_id string, target_id string, "
             "source_type string, target_type string, props map<string,string>, error string")


@dataclass(frozen=True)
class Extraction:
    """Tagged rows of one pass; the three views filter it."""
    tagged: DataFrame
    entities: DataFrame
    relations: DataFrame
    errors: DataFrame


def extract_with(df: DataFrame, func: Callable, rules: dict | None = None) -> Extraction:
    """Run a user function ``(row, rules) -> (entities, relations)`` on every record.

    Rows reach the function as dictionaries of Python values, so nullable whole numbers stay whole.
    An error in one row becomes an error row. Persist ``tagged`` before using more than one view.
    """
    known = {"type", "id", "source_id", "source", "target_id", "target", "source_type",
             "target_type", "properties"}

    def text(value) -> str | None:
        return None if value is None else str(value)

    def row_of(kind: str, item: dict) -> dict:
        props = {**{k: v for k, v in item.items() if k not in known},
                 **(item.get("properties") or {})}
        relation = kind == "relation"
        return {
            "kind": kind, "type": text(item.get("type") or ("RELATED_TO" if relation else "Entity")),
            "id": text(item.get("id")),
            "source_id": text(item.get("source_id") or item.get("source")) if relation else None,
            "target_id": text(item.get("target_id") or item.get("target")) if relation else None,
            "source_type": text(item.get("source_type", "Entity")) if relation else None,
            "target_type": text(item.get("target_type", "Entity")) if relation else None,
            "props": {str(k): str(v) for k, v in props.items() if v is not None}, "error": None}

    def failure(message: str) -> dict:
        return {**dict.fromkeys(fields), "kind": "error", "error": message}

    fields = [part.strip().split(" ")[0] for part in EXTRACTED.split(", ")]

    kept = pa.schema([(f, pa.map_(pa.string(), pa.string()) if f == "props" else pa.string()) for f in fields])

    def results(record: dict) -> list[dict]:
        try:
            entities, relations = func(record, rules or {})
            return [*(row_of("entity", e) for e in entities), *(row_of("relation", r) for r in relations)]
        except Exception as e:
            return [failure(f"{type(e).__name__}: {e}")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row for record in batch.to_pylist() for row in results(record)]
            for row in rows:
                row["props"] = list(row["props"].items()) if row["props"] is not None else None
            yield pa.RecordBatch.from_pylist(rows, kept)

    tagged = df.mapInArrow(run, EXTRACTED)
    return Extraction(
        tagged,
        tagged.filter("kind = 'entity'").select("type", "id", "props"),
        tagged.filter("kind = 'relation'").select(*RELATION_FIELDS, "props"),
        tagged.filter("kind = 'error'").select("error"))
