"""Scans of JSON lines, JSON and CSV, strict or lenient, with files and line numbers."""

from __future__ import annotations

import json
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType


def numbered_lines(spark: SparkSession, path: str, missing_ok: bool = False) -> DataFrame:
    """file, row_index, value: the physical lines of the text files below a path, numbered from 1 in each file.

    Files are split as usual, so their size doesn't matter: a line's number is its place in its
    block and the lines of the file's blocks before it, which a second pass over the lines
    counts. ``missing_ok``: a path that isn't there has no lines.
    """
    try:
        read = spark.read.option("recursiveFileLookup", "true").text(path)
    except AnalysisException as e:
        if not missing_ok or e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "file string, row_index bigint, value string")
    lines = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    blocks = lines.groupBy("file", "block").agg(F.min("at").alias("low"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))  # a row for each block
    blocks = blocks.select("file", "block", "low", F.coalesce(before, F.lit(0)).alias("before"))
    return lines.join(blocks, ["file", "block"]).select("file", (F.col("at") - F.col("low") + F.col("before") + 1).alias("row_index"), "value")


def strict_json_lines(spark: SparkSession, path: str, schema: StructType | str, required: tuple[str, ...] = (), missing_ok: bool = False) -> DataFrame:
    """Rows of a schema; blank lines are skipped. A line that isn't a JSON object of the schema, or lacks a required
    field, raises an error that names it as path:line."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    lines = numbered_lines(spark, path, missing_ok).where(F.trim("value") != "")
    whole = StructType([*schema.fields, StructField("__bad", StringType())])
    parsed = lines.withColumn("row", F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}))
    place = F.concat(F.col("file"), F.lit(":"), F.col("row_index").cast("string"))
    fault = F.when(~F.startswith(F.ltrim("value"), F.lit("{")) | F.col("row").isNull() | F.col("row.__bad").isNotNull(), F.concat(place, F.lit(" must be a JSON object of the schema")))
    for c in required:
        fault = F.coalesce(fault, F.when(F.col(f"row.`{c}`").isNull(), F.concat(place, F.lit(f" has no {c}"))))
    checked = parsed.withColumn("row", F.when(fault.isNull(), F.col("row")).otherwise(F.raise_error(fault).cast(whole)))
    return checked.select(*[F.col("row")[f.name].alias(f.name) for f in schema.fields])


def lenient_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, row_index, value, issue: physical lines from 1, blank ones left out.

    issue: invalid_json for a line that can't be parsed, invalid_schema for one that
    isn't an object, else null.
    """
    parsed = F.try_parse_json("value")
    issue = F.when(parsed.isNull(), "invalid_json").when(~F.schema_of_variant(parsed).startswith("OBJECT"), "invalid_schema")
    return numbered_lines(spark, path).where(F.trim("value") != "").withColumn("issue", issue)


def split_files(spark: SparkSession, root: str, split: str, schema: StructType | str) -> DataFrame:
    """Rows of the JSON lines in ``root/split/**`` and ``root/split*.jsonl``, each file once."""
    here = rf"/{re.escape(split)}(/.*|[^/]*)\.jsonl$"
    base = root.rstrip("/").rsplit("/", 1)[-1]
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").json(root)
    return rows.where(F.col("_metadata.file_path").rlike(rf"/{re.escape(base)}{here}"))


def checked_split(df: DataFrame, own: str, file=None) -> DataFrame:
    """``df`` itself; a row whose own split isn't the one its file's path names raises an error when it is read."""
    path = F.col("file") if file is None else file
    bad = ~F.col(own).eqNullSafe(split_from_path(path))
    said = F.concat(path, F.lit(" holds a row of split "), F.coalesce(F.col(own), F.lit("null")))
    return df.withColumn(own, F.when(bad, F.raise_error(said).cast("string")).otherwise(F.col(own)))


def smoke_rows(spark: SparkSession, path: str, schema: StructType | str, turns: str, tools: tuple[str, ...]) -> DataFrame:
    """The rows of a smoke set; raises ValueError if there is none or one breaks the lax rules for dialogues."""
    from ..operators.audit import issues, smoke_rules

    rows = strict_json_lines(spark, path, schema)
    found = issues(rows, [], smoke_rules(turns, tools)).select("code").distinct()
    if rows.isEmpty():
        raise ValueError(f"{path} has no rows")
    codes = sorted(r.code for r in found.collect())  # as many as rules
    if codes:
        raise ValueError(f"{path}: {', '.join(codes)}")
    return rows


def split_from_path(file=None):
    """train, validation or test by a folder's or file's name, in that order; else unknown."""
    path = F.lower(F.col("file") if file is None else file)
    named = lambda s: path.rlike(rf"(^|/){s}(/|[^/]*$)")
    return F.when(named("train"), "train").when(named("validation"), "validation").when(named("test"), "test").otherwise("unknown")


def tables(spark: SparkSession, path: str, schema: StructType | str, large: bool = False) -> DataFrame:
    """CSV (with header), JSON (a list, or an object with ``data``) and JSON lines below a folder, together.

    Columns missing in a file are null. Files of other kinds are left aside. A JSON file is one task's, unless they are
    said to be ``large``: then each is read by many (``jsonarrays``), and must be a list or have ``data`` as its first member.
    """
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    read = lambda glob: spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    text = StructType([f for f in schema.fields if f.dataType.simpleString() == "string"])
    out = read("*.jsonl").schema(schema).json(path)
    if large:
        from . import jsonarrays

        return _with_csv(out.unionByName(jsonarrays.rows(spark, path, schema)), read, text, path)
    whole = StructType().add("data", ArrayType(schema))
    listed = read("*.json").schema(schema).option("multiLine", "true").json(path)
    nested = read("*.json").schema(whole).option("multiLine", "true").json(path)
    out = out.unionByName(listed.where(F.coalesce(*[F.col(f.name).cast("string") for f in schema.fields]).isNotNull()))
    out = out.unionByName(nested.select(F.inline("data")))
    return _with_csv(out, read, text, path)


def _with_csv(out: DataFrame, read, text: StructType, path: str) -> DataFrame:
    try:
        named = read("*.csv").option("header", "true").csv(path)
    except Exception as e:
        if "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return out
    names = {c.lstrip("﻿"): c for c in named.columns}
    return out.unionByName(named.select(*[F.col(f"`{names[f.name]}`").alias(f.name) for f in text.fields if f.name in names]), allowMissingColumns=True)


def telemetry(spark: SparkSession, path: str) -> DataFrame:
    """CSV samples with blanks around values; all columns but time, name and uuid as numbers."""
    df = spark.read.option("header", "true").csv(path)
    text = ("timestamp", "name", "uuid")
    return df.select(*[(F.trim(F.col(f"`{c}`")) if c.strip() in text else F.trim(F.col(f"`{c}`")).cast("double")).alias(c.strip()) for c in df.columns])


def aligned(parts: list[DataFrame]) -> DataFrame:
    """Union by name; columns in the order of their first occurrence, missing ones null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def config(text: str) -> dict:
    """A JSON object; anything else raises ValueError."""
    value = json.loads(text)
    if not isinstance(value, dict):
        raise ValueError("a configuration is a JSON object")
    return value


def sidecar(df: DataFrame) -> DataFrame:
    """Metadata rows keyed by file and row_index: back-slashes become slashes; bad or repeated keys raise."""
    clean = df.withColumn("file", F.replace("file", F.lit("\\"), F.lit("/")))
    if not clean.where("file is null or row_index is null or row_index < 1").isEmpty():
        raise ValueError("a sidecar row needs a file and a row number from 1")
    if not clean.groupBy("file", "row_index").count().where("count > 1").isEmpty():
        raise ValueError("a sidecar row is given twice")
    return clean


def with_sidecar(rows: DataFrame, side: DataFrame) -> DataFrame:
    """Rows with sidecar columns laid over their own; the join may broadcast a small sidecar."""
    extra = [c for c in side.columns if c not in ("file", "row_index")]
    s = side.select("file", "row_index", *[F.col(c).alias(f"__{c}") for c in extra])
    joined = rows.join(s, ["file", "row_index"], "left")
    for c in extra:
        joined = joined.withColumn(c, F.coalesce(f"__{c}", c) if c in rows.columns else F.col(f"__{c}"))
    return joined.drop(*[f"__{c}" for c in extra])


def source_allowed(source: dict, rights_acknowledged: bool) -> None:
    """Raises PermissionError for a source whose access isn't automatic unless rights are acknowledged."""
    if source.get("access") != "automatic" and not rights_acknowledged:
        raise PermissionError(f"rights to {source.get('source_id')} must be acknowledged")
