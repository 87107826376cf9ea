"""Validation of model versions: structure, references, duplicates, join keys, naming rules.

Findings are rows ``model_id, version_id, rule, path, value, message``; each rule is a predicate, a
join or an aggregate over all versions at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semgraph.sources.models import KEY, Registry

# Allowed values and name patterns of the model language (fixed values).
CARDINALITIES = ("one_to_one", "one_to_many", "many_to_one", "many_to_many")
PROPERTY_TYPES = ("string", "number", "integer", "decimal", "boolean", "date", "timestamp", "time",
                  "array", "object")
METRIC_TYPES = ("sum", "count", "average", "min", "max", "distinct_count", "custom")
DIMENSION_TYPES = ("categorical", "temporal", "geographic", "numeric")
UPPER_NAME = "^[A-Z][a-zA-Z0-9_]*$"
LOWER_NAME = "^[a-z][a-zA-Z0-9_]*$"
VERSION = "^[0-9]+[.][0-9]+[.][0-9]+$"

# JSON value kinds as they are named in messages (fixed values).
JSON_KINDS = {"OBJECT": "dict", "STRING": "str", "BIGINT": "int", "BOOLEAN": "bool",
              "DOUBLE": "float", "DECIMAL": "float", "VOID": "NoneType"}

FINDING = ["rule", "path", "value", "message"]


def finding(when: Column, rule: str, path: Column, value: Column, message: Column) -> Column:
    return F.when(when, F.struct(F.lit(rule).alias("rule"), path.alias("path"),
                                 value.cast("string").alias("value"), message.alias("message")))


def _emit(df: DataFrame, *checks: Column) -> DataFrame:
    return df.select(*KEY, F.inline(F.array_compact(F.array(*checks))))


def _at(section: str, suffix: str = "") -> Column:
    return F.concat(F.lit(f"{section}["), F.col("pos").cast("string"), F.lit(f"]{suffix}"))


def _cat(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def structure_errors(models: DataFrame, raw: str = "raw") -> DataFrame:
    """Missing ``version`` or ``objects``, ``objects`` not an array, or empty; on raw JSON text."""
    keys = F.json_object_keys(F.col(raw))
    value = F.try_variant_get(F.try_parse_json(F.col(raw)), "$.objects", "variant")
    kind = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    flat = [F.lit(x) for pair in JSON_KINDS.items() for x in pair]
    shown = F.coalesce(F.element_at(F.create_map(*flat), kind), F.lit("NoneType"))
    has = F.array_contains(keys, "objects")
    null = F.lit(None).cast("string")
    size = F.json_array_length(F.get_json_object(F.col(raw), "$.objects"))
    return _emit(
        models,
        finding(~F.coalesce(F.array_contains(keys, "version"), F.lit(False)), "structure",
                F.lit("version"), null, F.lit("Missing required field: 'version'")),
        finding(~F.coalesce(has, F.lit(False)), "structure", F.lit("objects"), null,
                F.lit("Missing required field: 'objects'")),
        finding(has & (F.coalesce(kind, F.lit("VOID")) != "ARRAY"), "structure", F.lit("objects"),
                shown, F.lit("Field 'objects' must be an array")),
        finding(has & (kind == "ARRAY") & (size == 0), "structure", F.lit("objects"), null,
                F.lit("Field 'objects' cannot be empty")))


def object_references(reg: Registry) -> DataFrame:
    """Every place that names an object: ``kind, element, path, object, value``."""
    rels = reg.relationships.select(*KEY, F.inline(F.array(*[
        F.struct(F.lit("relationship").alias("kind"), F.col("name").alias("element"),
                 _at("relationships", f".{end}").alias("path"),
                 F.col(f"{end}_object").alias("object"), F.col(f"{end}_object").alias("value"))
        for end in ("from", "to")])))
    grains = reg.metrics.select(
        *KEY, "name", "pos", F.posexplode("grain").alias("_j", "object")).select(
        *KEY, F.lit("metric").alias("kind"), F.col("name").alias("element"),
        _cat(_at("metrics"), ".grain[", F.col("_j").cast("string"), "]").alias("path"),
        "object", F.col("object").alias("value"))
    dims = reg.dimensions.filter(F.col("source_property").contains(".")).select(
        *KEY, F.lit("dimension").alias("kind"), F.col("name").alias("element"),
        _at("dimensions", ".sourceProperty").alias("path"),
        F.substring_index("source_property", ".", 1).alias("object"),
        F.col("source_property").alias("value"))
    return rels.unionByName(grains).unionByName(dims)


def known_objects(reg: Registry) -> DataFrame:
    """``key, _objects``: the object names of a version, one row each. Joins go by the key alone, so tables that hold
    a version's rows together need no shuffle."""
    return reg.objects.groupBy(*KEY).agg(F.collect_set("name").alias("_objects"))


def owned(owner: Column, name: Column) -> Column:
    """An object and its property as one text."""
    return F.concat(owner, F.lit("\0"), name)


def known_properties(reg: Registry) -> DataFrame:
    """``key, _properties``: the properties of a version with their objects, one row each."""
    return reg.properties.groupBy(*KEY).agg(F.collect_set(owned(F.col("object"), F.col("name"))).alias("_properties"))


def is_in(names: str, value: Column) -> Column:
    """Whether an array column, which may be missing, holds a value; not if that is null."""
    return F.coalesce(F.array_contains(F.col(names), value), F.lit(False))


def reference_errors(reg: Registry) -> DataFrame:
    """Relationship ends, metric grains and dimension sources that name an unknown object, and
    dimension sources that are not ``Object.property``. One join serves all of them."""
    dangling = object_references(reg).join(known_objects(reg), KEY, "left").filter(~is_in("_objects", F.col("object")))
    title = F.initcap("kind")
    unknown = dangling.select(
        *KEY, F.lit("reference").alias("rule"), "path", "value",
        _cat(title, " '", F.col("element"), "' references unknown object '", F.col("object"), "'")
        .alias("message"))
    bad_form = _emit(reg.dimensions, finding(
        ~F.col("source_property").contains("."), "reference",
        _at("dimensions", ".sourceProperty"), F.col("source_property"),
        _cat("Dimension '", F.col("name"), "' has invalid sourceProperty format '",
             F.col("source_property"), "'. Expected format: 'Object.property'")))
    return unknown.unionByName(bad_form)


def duplicate_names(reg: Registry) -> DataFrame:
    """Later occurrences of an object or metric name, each with the position of the first."""
    named = reg.objects.select(*KEY, F.lit("objects").alias("section"), "name", "pos").unionByName(
        reg.metrics.select(*KEY, F.lit("metrics").alias("section"), "name", "pos"))
    named = named.filter("name is not null and name <> ''")
    same = Window.partitionBy(*KEY, "section", "name")
    repeated = (named.dropna(subset=KEY).withColumn("first_pos", F.min("pos").over(same))
                .filter("pos > first_pos"))
    place = _cat(F.col("section"), "[", F.col("pos").cast("string"), "]")
    single = F.regexp_replace("section", "s$", "")
    return repeated.select(
        *KEY, F.lit("duplicate").alias("rule"), _cat(place, ".name").alias("path"),
        F.col("name").alias("value"),
        _cat("Duplicate ", single, " name '", F.col("name"), "' found at ", place,
             ". First occurrence at ", F.col("section"), "[", F.col("first_pos").cast("string"), "]")
        .alias("message"))


def cardinality_errors(reg: Registry) -> DataFrame:
    return _emit(reg.relationships, finding(
        ~F.col("cardinality").isin(*CARDINALITIES), "cardinality",
        _at("relationships", ".cardinality"), F.col("cardinality"),
        _cat("Relationship '", F.col("name"), "' has invalid cardinality '", F.col("cardinality"),
             "'")))


def join_key_sides(relationships: DataFrame, *keep: str) -> DataFrame:
    """Each side of each join key: ``name, pos, j, side, object, property`` and the columns ``keep``."""
    pairs = relationships.select(
        *KEY, *keep, "name", "pos", "from_object", "to_object",
        F.posexplode("join_keys").alias("j", "_k"))
    return pairs.select(*KEY, *keep, "name", "pos", "j", F.inline(F.array(
        F.struct(F.lit(0).alias("side"), F.col("from_object").alias("object"),
                 F.col("_k.from_key").alias("property")),
        F.struct(F.lit(1).alias("side"), F.col("to_object").alias("object"),
                 F.col("_k.to_key").alias("property")))))


def unresolved_join_keys(reg: Registry) -> DataFrame:
    """Join-key sides whose property is missing, ``object_known`` telling whether the object is."""
    known = reg.relationships.join(known_properties(reg), KEY, "left").join(known_objects(reg), KEY, "left")
    sides = join_key_sides(known, "_properties", "_objects")
    missing = sides.filter(~is_in("_properties", owned(F.col("object"), F.col("property"))))
    return missing.withColumn("object_known", is_in("_objects", F.col("object"))).drop("_properties", "_objects")


def join_key_errors(reg: Registry) -> DataFrame:
    """Join keys that name unknown objects or properties, in models with a mapping block."""
    mapped = reg.models.filter("has_mapping").select(*KEY)
    bad = unresolved_join_keys(reg).join(mapped, KEY, "left_semi")
    what = F.when(F.col("object_known"), _cat(
        "property '", F.col("property"), "' in object '", F.col("object"), "'")).otherwise(
        _cat("object '", F.col("object"), "'"))
    return bad.select(
        *KEY, F.lit("join_key").alias("rule"),
        _cat(_at("relationships"), ".joinKeys[", F.col("j").cast("string"), "][",
             F.col("side").cast("string"), "]").alias("path"),
        F.when(F.col("object_known"), F.col("property")).otherwise(F.col("object")).alias("value"),
        _cat("Relationship '", F.col("name"), "' join key references unknown ", what)
        .alias("message"))


def schema_errors(reg: Registry) -> DataFrame:
    """Name patterns, required fields and enumerations of the model language."""
    def shape(column: str, pattern: str, path: Column) -> Column:
        return finding(~F.coalesce(F.col(column).rlike(pattern), F.lit(False)), "pattern", path,
                       F.col(column), _cat(path, f" does not match {pattern}"))

    def member(column: str, allowed: tuple[str, ...], path: Column) -> Column:
        return finding(~F.coalesce(F.col(column).isin(*allowed), F.lit(False)), "enum", path,
                       F.col(column), _cat(path, " is not an allowed value"))

    def filled(column: str, path: Column) -> Column:
        return finding(F.coalesce(F.size(column), F.lit(0)) == 0, "required", path,
                       F.lit(None).cast("string"), _cat(path, " must not be empty"))

    prop_at = _cat("objects[", F.col("object"), "].properties[", F.col("pos").cast("string"), "]")
    parts = [
        _emit(reg.models, shape("version", VERSION, F.lit("version"))),
        _emit(reg.objects, shape("name", UPPER_NAME, _at("objects", ".name"))),
        _emit(reg.properties, shape("name", LOWER_NAME, _cat(prop_at, ".name")),
              member("type", PROPERTY_TYPES, _cat(prop_at, ".type"))),
        _emit(reg.relationships, shape("name", LOWER_NAME, _at("relationships", ".name")),
              shape("from_object", UPPER_NAME, _at("relationships", ".from")),
              shape("to_object", UPPER_NAME, _at("relationships", ".to")),
              filled("join_keys", _at("relationships", ".joinKeys")),
              member("cardinality", CARDINALITIES, _at("relationships", ".cardinality"))),
        _emit(reg.metrics, shape("name", UPPER_NAME, _at("metrics", ".name")),
              filled("grain", _at("metrics", ".grain")),
              member("type", METRIC_TYPES, _at("metrics", ".type"))),
        _emit(reg.dimensions, shape("name", UPPER_NAME, _at("dimensions", ".name")),
              member("type", DIMENSION_TYPES, _at("dimensions", ".type"))),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def validate_models(reg: Registry, level: str = "references",
                    raw_models: DataFrame | None = None) -> DataFrame:
    """All findings. ``level="schema"`` adds the naming and enumeration rules; ``raw_models`` adds
    the structure rules, which only raw JSON shows."""
    out = reference_errors(reg)
    for part in (duplicate_names(reg), cardinality_errors(reg), join_key_errors(reg)):
        out = out.unionByName(part)
    if level == "schema":
        out = out.unionByName(schema_errors(reg))
    if raw_models is not None:
        out = out.unionByName(structure_errors(raw_models))
    return out
