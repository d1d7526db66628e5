"""JSON files that hold one large array, read by many tasks.

A file is cut at closing braces, as lines are at line ends, so Spark splits it wherever it likes. Whether a piece begins
within a string follows from the parity of the quotes before it, how deep it begins from the braces before it that stand in no string.
Sums over a block's pieces and over the blocks before it tell both; the pieces of a record then meet by its number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .sinks import checkpointed

#: What stands before the records: a list, or an object whose first member is the list ``data``.
OPENING = r"^\s*(?:\{\s*\"data\"\s*:\s*)?\[\s*"


def _before(pieces: DataFrame, value: Column, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over all pieces of the file before this one."""
    block = Window.partitionBy("file", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    blocks = pieces.groupBy("file", "block").agg(F.sum(value).alias("s"))
    earlier = F.sum("s").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))  # a row for each block
    starts = blocks.select(F.col("file").alias("b_file"), F.col("block").alias("b_block"), F.coalesce(earlier, F.lit(0)).alias("b_s"))
    out = pieces.withColumn("here", F.coalesce(F.sum(value).over(block), F.lit(0))).join(starts, (F.col("file") == F.col("b_file")) & (F.col("block") == F.col("b_block")))
    return out.withColumn(name, F.col("here") + F.col("b_s")).drop("here", "b_file", "b_block", "b_s")


def _count(text: Column, sign: str) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(sign), F.lit("")))


def records(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """file, nth, record: the text of each object of the array in each file below a folder, in order from 0.

    A file is a list of objects, or an object whose first member ``data`` is one; raises ValueError for files of another form.
    An empty list has no rows; what an object holds behind ``data``, and elements without a brace, are left out. No task holds more
    than a block of a file and a record.
    """
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("lineSep", "}").text(path)
    # The number grows within a task, and a block is read by one.
    pieces = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("text"))
    # Escapes stand in strings only, and none crosses a brace.
    plain = F.regexp_replace("text", r"\\.", "")
    pieces = checkpointed(pieces.withColumn("quotes", F.pmod(_count(plain, '"'), F.lit(2))))
    heads = pieces.groupBy("file").agg(F.min(F.struct("block", "id", "text")).alias("x")).select("file", F.col("x.text").alias("head"))  # a row for each file
    odd = heads.where(~F.col("head").rlike(OPENING)).limit(1).collect()
    if odd:
        raise ValueError(f"{odd[0].file} is no list of objects")
    within = _before(pieces, F.col("quotes"), "quoted").withColumn("inside", F.col("quoted") % 2 == 1)
    # What stands in no string: after the first quote if the piece begins in one, and without whole strings and a last open one.
    bare = F.when(F.col("inside"), F.regexp_replace(plain, r'^[^"]*(?:"|$)', "")).otherwise(plain)
    bare = F.regexp_replace(bare, r'"[^"]*(?:"|$)', "")
    ends_in = F.pmod(F.col("quoted") + F.col("quotes"), F.lit(2)) == 1  # then the brace behind the piece is text
    within = within.withColumn("opens", _count(bare, "{")).withColumn("closes", F.when(ends_in, 0).otherwise(1))
    within = checkpointed(within.withColumn("lists", _count(bare, "[") - _count(bare, "]")).drop("quoted", "quotes"))
    deep = _before(within, F.col("opens") - F.col("closes"), "depth")
    deep = _before(checkpointed(deep), F.col("lists"), "listed")
    base = heads.select(F.col("file").alias("h_file"), F.when(F.col("head").rlike(r"^\s*\{"), 1).otherwise(0).alias("base"))
    deep = deep.join(base, F.col("file") == F.col("h_file")).drop("h_file")
    # A record ends where the depth is that of the list again; the list itself is open as long as one bracket more is.
    after = F.col("depth") + F.col("opens") - F.col("closes")
    ends = ((F.col("closes") == 1) & (after == F.col("base")) & (F.col("listed") + F.col("lists") == 1)).cast("int")
    numbered = _before(checkpointed(deep.withColumn("ends", ends)), F.col("ends"), "nth")
    whole = numbered.groupBy("file", "nth").agg(F.array_sort(F.collect_list(F.struct("block", "id", "text"))).alias("x"), F.max("ends").alias("ended"))
    joined = F.array_join(F.transform("x", lambda p: p["text"]), "}")
    # Before a record stand what opens the list, or the comma behind the one before, and elements of other kinds.
    record = F.concat(F.regexp_replace(joined, F.when(F.col("nth") == 0, F.lit(OPENING)).otherwise(F.lit("^")), F.lit("")), F.lit("}"))
    out = whole.where("ended = 1").select("file", "nth", record.alias("t"))
    return out.select("file", "nth", F.regexp_extract("t", r"(?s)(\{.*)$", 1).alias("record"))


def rows(spark: SparkSession, path: str, schema: StructType | str, glob: str = "*.json") -> DataFrame:
    """The objects of ``records`` by a schema; members that it doesn't name are left out."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return records(spark, path, glob).select(F.from_json("record", schema).alias("x")).select("x.*")
