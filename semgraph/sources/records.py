"""Record and file sources."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# File extension → kind of file (fixed values).
FILE_TYPES = {
    ".json": "json",
    ".csv": "csv",
    ".txt": "text",
    ".xml": "xml",
    ".pdf": "pdf",
    ".docx": "document",
    ".xlsx": "spreadsheet",
    ".xls": "spreadsheet",
}


GLOBS = {"json": "*.json", "csv": "*.csv", "text": "*.txt", "xml": "*.xml"}


def _extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def _read_one(spark: SparkSession, path: str, fmt: str, row_tag: str,
              schema: T.StructType | str | None, options: dict) -> DataFrame:
    folder = not path.rstrip("/").lower().endswith(tuple(FILE_TYPES))
    if fmt in ("json", "csv") and "multiline" not in {o.lower() for o in options}:
        whole, by_line = _by_layout(spark, path, fmt, folder)
        if whole:
            parts = [_read_files(spark, files, fmt, schema, {**options, "multiLine": more})
                     for files, more in ((whole, True), (by_line, False)) if files]
            return parts[0].unionByName(parts[1], allowMissingColumns=True) if by_line else parts[0]
    reader = spark.read if schema is None else spark.read.schema(schema)
    if folder:
        reader = reader.option("pathGlobFilter", GLOBS[fmt]).option("recursiveFileLookup", "true")
    if fmt in ("json", "csv"):
        return _read_files(spark, path, fmt, schema, options, reader)
    if fmt == "xml":
        df = reader.options(**{"rowTag": row_tag, **options}).xml(path)
    else:
        df = reader.text(path, **options).withColumnRenamed("value", "content")
    return _with_source(df)


def _with_source(df: DataFrame) -> DataFrame:
    columns = [c for c in df.columns if c != "source"]
    return df.select(*[f"`{c}`" for c in columns], F.col("_metadata.file_path").alias("source"))


def _read_files(spark: SparkSession, files: str | list[str], fmt: str, schema: T.StructType | str | None,
                options: dict, reader: DataFrameReader | None = None) -> DataFrame:
    reader = reader or (spark.read if schema is None else spark.read.schema(schema))
    if fmt == "json":
        return _with_source(reader.options(**options).json(files))
    return _with_source(reader.options(**{"header": True, "escape": '"', **options}).csv(files))


def _by_layout(spark: SparkSession, path: str, fmt: str, folder: bool) -> tuple[list[str], list[str]]:
    """Names of the files whose records cross lines, and of the others, by a scan over their lines: csv files in which
    a line has an odd number of quotes; json files whose first line is no whole value."""
    reader = spark.read.option("pathGlobFilter", GLOBS[fmt]).option("recursiveFileLookup", "true") if folder else spark.read
    lines = reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")
    if fmt == "csv":
        open_quote = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
        found = lines.groupBy("file").agg(F.bool_or(open_quote).alias("crosses"))
    else:
        found = (lines.filter((F.trim("value") != "") & (F.col("at") == 0))
                 .withColumn("row", F.monotonically_increasing_id()).groupBy("file").agg(F.min_by("value", "row").alias("first"))
                 .select("file", F.expr("try_parse_json(first) IS NULL").alias("crosses")))
    names: tuple[list[str], list[str]] = ([], [])
    for row in found.orderBy("file").collect():  # names of files, as any listing
        names[not row.crosses].append(unquote(row.file))
    return names


def read_records(spark: SparkSession, path: str, fmt: str | None = None, row_tag: str = "row",
                 schema: T.StructType | str | None = None, **options) -> DataFrame:
    """Rows of json, csv, text or xml files with the file they came from in ``source``.

    The format follows the path's extension unless given. A folder without a format gives the rows
    of every format in it, united by column name; a file of any other kind there is an error that
    names it. Files are read by lines, so that large ones are split over tasks: one JSON object, CSV
    row or text line (``content``) each. Before that a scan finds the files whose records cross lines, JSON
    documents and arrays over several lines and CSV values with line feeds; each of them takes one task, the
    others stay split. ``multiLine`` set to True or False spares the scan. ``wholetext=True`` gives one row per text
    file. Give a ``schema`` in production: inference reads the files once more.
    """
    fmt = {"txt": "text"}.get(fmt, fmt) or FILE_TYPES.get("." + path.rsplit(".", 1)[-1].lower())
    if fmt is not None:
        if fmt not in GLOBS:
            raise ValueError(f"unsupported format {fmt!r}")
        return _read_one(spark, path, fmt, row_tag, schema, options)
    kinds = list_files(spark, path).groupBy("type").agg(F.min("path").alias("path")).collect()
    other = [r.path for r in kinds if r.type not in GLOBS]
    if other or not kinds:
        raise ValueError(f"no reader for {other}" if other else f"no files in {path}")
    # options of one format would be unknown to the others, so only the common ones are passed
    parts = [_read_one(spark, path, r.type, row_tag, None if r.type == "text" else schema, options)
             for r in sorted(kinds)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Name, path, size, modification time, extension and type of every file, newest first. File
    contents are not read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
             .select("path", "length", "modificationTime"))
    ext = _extension(F.col("path"))
    known = F.create_map(*[F.lit(x) for pair in FILE_TYPES.items() for x in pair])
    return files.select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "path",
        F.col("length").alias("size"), F.col("modificationTime").alias("modified"),
        ext.alias("extension"), F.coalesce(F.element_at(known, ext), F.lit("unknown")).alias("type"),
    ).orderBy(F.desc("modified"), "path")


def preview_files(spark: SparkSession, path: str, max_lines: int = 50) -> DataFrame:
    """The first lines of every text file: ``path, line_number, line``.

    Lines get their place within their split; the splits of a file follow by their start, so a head
    that crosses splits is whole. Each task keeps at most ``max_lines`` lines of a split."""
    lines = (spark.read.option("recursiveFileLookup", "true").text(path)
             .select(F.col("_metadata.file_path").alias("path"),
                     F.col("_metadata.file_block_start").alias("_block"), F.col("value").alias("line")))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = None, 0
        for batch in batches:
            at = list(zip(batch["path"].to_pylist(), batch["_block"].to_pylist()))
            numbers = []
            for split in at:
                number = number + 1 if split == held else 1
                held = split
                numbers.append(number)
            kept = batch.append_column("_row", pa.array(numbers, pa.int64()))
            yield kept.filter(pc.less_equal(kept["_row"], max_lines))

    kept = lines.mapInArrow(heads, "path string, _block long, line string, _row long")
    in_file = Window.partitionBy("path").orderBy("_block", "_row")
    return (kept.withColumn("line_number", F.row_number().over(in_file))
            .filter(F.col("line_number") <= max_lines).select("path", "line_number", "line"))


def read_expectations(spark: SparkSession, path: str) -> DataFrame:
    """Golden questions from a YAML or JSON file: ``question, expected_tables,
    expected_sql_patterns, expected_answer_snippet``. The file is a definition read on the driver."""
    import yaml

    text = spark.read.text(path, wholetext=True).first()
    items = (yaml.safe_load(text["value"]) or {}).get("questions", []) if text else []
    rows = [(q["question"], q.get("expected_tables"), q.get("expected_sql_patterns"),
             q.get("expected_answer_snippet")) for q in items]
    return spark.createDataFrame(
        rows, "question string, expected_tables array<string>, "
              "expected_sql_patterns array<string>, expected_answer_snippet string")
