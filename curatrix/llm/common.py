"""Shared plumbing: reading tables, running Arrow batches, word arrays, scratch folders."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import bounded_batches

#: Python works on slices of an Arrow batch of about this many text bytes, so that
#: temporary arrays stay small whatever the batch size is.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(df: DataFrame, name: str) -> Column:
    """A top-level column by its literal name, dots and spaces included."""
    return df["`" + name.replace("`", "``") + "`"]


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that no column of ``df`` has, in whatever case."""
    taken, made = {c.lower() for c in df.columns}, f"__{name}"
    while made.lower() in taken:
        made += "_"
    return made


def text_or_empty(df: DataFrame, name: str) -> Column:
    return F.coalesce(column(df, name).cast("string"), F.lit(""))


def slices(batch: pa.RecordBatch, text_index: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of about ``size`` bytes of text, at least one row each."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_index)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        floor = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, floor + size, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def map_texts(
    df: DataFrame,
    keep: dict[str, Column],
    text: Column,
    fields: str,
    factory: Callable[[], Callable[..., list[pa.Array]]],
    slice_bytes: int = SLICE_BYTES,
    beside: tuple[Column, ...] = (),
) -> DataFrame:
    """Row-wise operator: ``keep`` columns pass through, ``fields`` (a DDL list) are computed.

    ``factory()`` runs once for a task and returns a function from the (never null)
    texts of a slice, and its values of the columns ``beside`` them, to one Arrow array for each field.
    """
    bounded_batches(df.sparkSession)
    source = df.select(*[c.alias(f"k{i}") for i, c in enumerate(keep.values())], text.alias("t"), *[c.alias(f"x{i}") for i, c in enumerate(beside)])
    kept = ", ".join(f"`{n.replace('`', '``')}` {source.schema[i].dataType.simpleString()}" for i, n in enumerate(keep))
    last = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = factory()
        for batch in batches:
            for part in slices(batch, last, slice_bytes):
                made = work(*part.columns[last:])
                yield pa.RecordBatch.from_arrays([*part.columns[:last], *made], names=[*names])

    schema = f"{kept}, {fields}" if keep else fields
    names = [f.name for f in _parsed(df.sparkSession, schema)]
    return source.mapInArrow(run, schema)


def _parsed(spark: SparkSession, ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).fields


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array, and where each text starts (n + 1 offsets)."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64, n + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def flags(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Separators of whitespace words, and of the letters-and-digits words of the contracts.
SPACE = flags((0x20, 0x20), (0x09, 0x0D))
NOT_ALNUM = flags((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240607))
_MIX = _rng.integers(0, 2**64, (64, 256), dtype=np.uint64).reshape(-1)
_MUL = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every input bit touches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the index of each text's first word (n + 1 entries).

    A word never reaches over the border of two texts.
    """
    n = len(data)
    inside = ~separators[data]
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    first, last = inside.copy(), inside.copy()
    if n:
        first[1:] &= ~inside[:-1] | border[1:n]
        last[:-1] &= ~inside[1:] | border[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a sum of one random number for each (place, byte)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(first, lens)
    byte = data[place + np.repeat(starts, lens)]
    value = _MIX[((place & 63) << 8) | byte]
    if int(lens.max()) > 64:
        far = place >= 64
        value[far] = mix64(value[far] + (place[far] >> 6).astype(np.uint64) * _MUL)
    return mix64(np.add.reduceat(value, first) + lens.astype(np.uint64) * _MUL)


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, a local session gets a temporary
    folder for it; on a cluster, where executors share no local folder, it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        root = tempfile.mkdtemp(prefix="curatrix-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/curatrix-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """Cut the lineage: write as Parquet into the shared folder and read back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
