"""Token ids of texts, with the places they come from, by a vocabulary of the tokenizers library."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

IDS = "ids:array<int>"
TOKENS = f"array<struct<{IDS},starts:array<int>,ends:array<int>>>"
#: Characters of text that are encoded in one call; Python's lists of their tokens live as long.
SLICE = 1 << 18
#: Most bytes of an Arrow batch between the JVM and Python; rows of long texts make large ones.
BATCH_BYTES = 8 << 20


@lru_cache(maxsize=1)
def loaded(text: str):
    """The tokenizer of a vocabulary; a Python worker keeps the one it used last."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(text)
    made.no_truncation()
    made.no_padding()
    return made


def vocabulary(spark: SparkSession, path: str) -> str:
    """The JSON text of a tokenizer: through Spark if the path has a scheme, else a file on the driver's machine."""
    if "://" in path:
        return spark.read.text(path, wholetext=True).first().value
    with open(path, encoding="utf-8") as f:
        return f.read()


def token_id(text: str, token: str) -> int:
    """The id of a token of a vocabulary; raises ValueError if it has none."""
    found = loaded(text).token_to_id(token)
    if found is None:
        raise ValueError(f"the vocabulary has no token {token}")
    return found


def bounded_batches(spark: SparkSession) -> None:
    """Let no Arrow batch of this session grow far beyond BATCH_BYTES; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key)).upper()
    digits = now.rstrip("B")
    if not digits.isdigit() or not 0 < int(digits) <= BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def _lists(parts: list, kind: pa.DataType) -> pa.ListArray:
    n = np.array([len(p) for p in parts], np.int64)
    flat = np.concatenate([np.zeros(0, np.int32), *[p for p in parts if len(p)]])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(flat, kind))


def encoded(tokenizer, texts: Sequence[str], special: np.ndarray, places: bool = True) -> pa.StructArray:
    """ids, and with ``places`` starts and ends (characters of the text), of each text; special tokens are added where
    ``special`` says so. Beside the result, no more than SLICE characters, or one text, are held in Python's objects."""
    names = ["ids", "starts", "ends"] if places else ["ids"]
    out, at = [[] for _ in names], 0
    while at < len(texts):
        part, size = [], 0
        while at + len(part) < len(texts) and special[at + len(part)] == special[at]:
            text = texts[at + len(part)]
            if part and size + len(text) > SLICE:
                break
            part.append(text)
            size += len(text)
        for e in tokenizer.encode_batch(part, add_special_tokens=bool(special[at])):
            out[0].append(np.array(e.ids, np.int32))
            if places:
                both = np.array(e.offsets, np.int32).reshape(-1, 2)
                out[1].append(both[:, 0].copy())
                out[2].append(both[:, 1].copy())
        at += len(part)
    return pa.StructArray.from_arrays([_lists(x, pa.int32()) for x in out], names=names)


class _Texts(Sequence):
    """The texts of an Arrow array, read one at a time; a null is empty."""

    def __init__(self, values: pa.Array):
        self.values = values

    def __len__(self) -> int:
        return len(self.values)

    def __getitem__(self, i: int) -> str:
        return self.values[i].as_py() or ""


def tokens(spark: SparkSession, text: str, special_first: bool = False, places: bool = True) -> Callable[[Column], Column]:
    """A function from an array of texts to an array of their tokens (ids, starts, ends; without ``places`` ids only).

    ``text`` is the vocabulary. Texts are encoded whole; null ones, and nulls in place of the array, count as empty. With
    ``special_first`` the first text of an array gets the tokens that open an input.
    """
    held = spark.sparkContext.broadcast(text)  # a vocabulary: some MB, whatever the tables' size
    bounded_batches(spark)

    @F.arrow_udf(TOKENS if places else f"array<struct<{IDS}>>")
    def run(column: pa.Array) -> pa.Array:
        n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(n)])
        first = np.zeros(int(offsets[-1]), bool)
        if special_first:
            first[offsets[:-1][n > 0]] = True
        made = encoded(loaded(held.value), _Texts(column.flatten()), first, places)  # what stands at nulls is left out
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), made)

    return run
