"""Model registry: model documents, and the element tables they explode to.

Every registry operator works on the element tables, keyed by ``model_id, version_id``. A model of
any size is therefore just more rows; nothing gathers a whole model in one place.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["model_id", "version_id"]

_PLACE = "struct<table:string,schema:string,database:string>"
_BLOCK = ("struct<database:string,schema:string,warehouse:string,"
          "tableMappings:map<string,string>>")
MODEL_SCHEMA = f"""struct<
    version:string, name:string, description:string,
    objects:array<struct<name:string,description:string,identifiers:array<string>,
        properties:array<struct<name:string,type:string,description:string,
            nullable:boolean,required:boolean>>,
        mapping:{_PLACE},snowflake:{_PLACE}>>,
    relationships:array<struct<name:string,description:string,`from`:string,`to`:string,
        joinKeys:array<array<string>>,cardinality:string>>,
    metrics:array<struct<name:string,description:string,expression:string,
        grain:array<string>,type:string,format:string>>,
    dimensions:array<struct<name:string,description:string,sourceProperty:string,type:string>>,
    mapping:{_BLOCK}, snowflake:{_BLOCK}>""".replace("\n", " ")


@dataclass(frozen=True)
class Registry:
    """Element tables of many model versions.

    models         key, version, name, description, has_mapping, database, schema
    objects        key, pos, ord, name, description, identifiers, table, schema, database
    properties     key, object, pos, ord, name, type, description, nullable, required
    relationships  key, pos, ord, name, from_object, to_object, join_keys, cardinality, description
    metrics        key, pos, ord, name, expression, grain, type, format, description
    dimensions     key, pos, ord, name, source_property, type, description

    ``pos`` is the position in the document, ``ord`` the position after sorting by name.
    """
    models: DataFrame
    objects: DataFrame
    properties: DataFrame
    relationships: DataFrame
    metrics: DataFrame
    dimensions: DataFrame

    def map(self, change) -> "Registry":
        """The registry with ``change`` applied to every table."""
        return Registry(**{f.name: change(getattr(self, f.name)) for f in fields(self)})

    def version(self, condition: Column) -> "Registry":
        """Only the versions that meet a condition on the key."""
        return self.map(lambda df: df.filter(condition))


def read_models(spark: SparkSession, path: str, pattern: str = "*.json",
                id_pattern: str = r"([^/]+)\.[^./]+$") -> DataFrame:
    """One row per JSON model file: ``model_id`` (what ``id_pattern`` captures of the path, the file
    name by default), ``version_id``, ``raw`` and the parsed ``doc``. The executors read and parse."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True,
                            pathGlobFilter=pattern)
    name = F.regexp_extract(F.col("_metadata.file_path"), id_pattern, 1)
    return (files.select(name.alias("model_id"), F.col("value").alias("raw"))
            .withColumn("doc", F.from_json("raw", MODEL_SCHEMA))
            .withColumn("version_id", F.coalesce("doc.version", F.lit("1.0.0")))
            .select(*KEY, "raw", "doc"))


def parse_models(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``doc`` parsed from a JSON text column."""
    return df.withColumn("doc", F.from_json(raw, MODEL_SCHEMA))


def _elements(models: DataFrame, column: str, keep: list[str] = ()) -> DataFrame:
    """Explode a list, each element with ``pos`` and ``ord``."""
    numbered = F.transform(F.col(column), lambda e, i: F.struct(
        e["name"].alias("_name"), i.alias("_pos"), e.alias("_e")))
    return models.select(*KEY, *keep, F.posexplode(F.array_sort(numbered)).alias("ord", "_x")) \
        .select(*KEY, *keep, F.col("_x._pos").alias("pos"), "ord", "_x._e.*")


def explode_model(models: DataFrame) -> Registry:
    """Normalise model documents: defaults filled in, lists numbered in name order, identifiers,
    grains and join keys sorted, table mappings merged."""
    block = F.coalesce("doc.mapping", "doc.snowflake")
    base = models.select(*KEY, "doc", block.alias("_block"))
    heads = base.select(
        *KEY, F.coalesce("doc.version", F.lit("1.0.0")).alias("version"),
        F.col("doc.name").alias("name"), F.col("doc.description").alias("description"),
        F.col("_block").isNotNull().alias("has_mapping"),
        F.col("_block.database").alias("database"), F.col("_block.schema").alias("schema"))

    def sorted_or_empty(col: str) -> Column:
        return F.array_sort(F.coalesce(F.col(col), F.expr("cast(array() as array<string>)")))

    listed = base.withColumn("_objects", F.col("doc.objects"))
    raw_objects = _elements(listed.withColumn("_map", F.col("_block.tableMappings")),
                            "_objects", ["_map", "_block"])
    own = F.coalesce("mapping", "snowflake")
    objects = raw_objects.select(
        *KEY, "pos", "ord", "name", "description",
        sorted_or_empty("identifiers").alias("identifiers"),
        F.coalesce(own["table"], F.element_at("_map", F.col("name")), F.lower("name")).alias("table"),
        F.coalesce(own["schema"], F.col("_block.schema")).alias("schema"),
        F.coalesce(own["database"], F.col("_block.database")).alias("database"))
    owned = raw_objects.select(*KEY, F.col("name").alias("object"), "properties")
    properties = _elements(owned, "properties", ["object"]).select(
        *KEY, "object", "pos", "ord", "name", "type", "description",
        F.coalesce("nullable", F.lit(True)).alias("nullable"),
        F.coalesce("required", F.lit(False)).alias("required"))
    rels = _elements(base.withColumn("_l", F.col("doc.relationships")), "_l")
    pairs = F.transform(F.coalesce("joinKeys", F.expr("cast(array() as array<array<string>>)")),
                        lambda k: F.struct(F.get(k, F.lit(0)).alias("from_key"),
                                           F.get(k, F.lit(1)).alias("to_key")))
    relationships = rels.select(
        *KEY, "pos", "ord", "name", F.col("from").alias("from_object"),
        F.col("to").alias("to_object"), F.array_sort(pairs).alias("join_keys"),
        F.coalesce("cardinality", F.lit("many_to_one")).alias("cardinality"), "description")
    metrics = _elements(base.withColumn("_l", F.col("doc.metrics")), "_l").select(
        *KEY, "pos", "ord", "name", "expression", sorted_or_empty("grain").alias("grain"),
        F.coalesce("type", F.lit("custom")).alias("type"), "format", "description")
    dimensions = _elements(base.withColumn("_l", F.col("doc.dimensions")), "_l").select(
        *KEY, "pos", "ord", "name",
        F.coalesce("sourceProperty", F.lit("")).alias("source_property"),
        F.coalesce("type", F.lit("categorical")).alias("type"), "description")
    return Registry(heads, objects, properties, relationships, metrics, dimensions)


def fingerprint(files: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Content fingerprint per key over ``path, content`` rows, independent of row order.

    SHA-256 of every row, summed limb by limb, and SHA-256 of the sums. Sums combine map-side, so
    a bundle of any size needs constant state instead of a sorted concatenation.
    """
    digest = F.sha2(F.concat_ws(":", "path", "content"), 256)
    hashed = files.select(*keys, digest.alias("_d"))
    limbs = [F.sum(F.conv(F.substring("_d", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)"))
             .cast("string").alias(f"_l{i}") for i in range(8)]
    summed = hashed.groupBy(*keys).agg(F.count("*").alias("n_files"), *limbs)
    text = F.concat_ws(":", F.col("n_files").cast("string"), *[f"_l{i}" for i in range(8)])
    return summed.select(*keys, "n_files", F.sha2(text, 256).alias("fingerprint"))
