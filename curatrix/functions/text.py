"""Text canonicalisation, hash ranks and canonical JSON, as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalized(c: Column | str, nfkc: bool = False) -> Column:
    """Lower case, runs of white space as one space, trimmed; with ``nfkc`` composed first.

    Without ``nfkc`` everything stays in the JVM; on text that is its own NFKC form, as
    plain Latin text is, both give the same. Null stays null.
    """
    text = column(c)
    low = F.lower(_nfkc(text) if nfkc else text)
    return F.regexp_replace(F.regexp_replace(low, r"(?U)\s+", " "), "^ | $", "")


def compact(c: Column | str) -> Column:
    """The text without any white space."""
    return F.regexp_replace(column(c), r"(?U)\s+", "")


def cleaned(c: Column | str, join_cjk: bool = False) -> Column:
    """Trimmed text, '' for null; with ``join_cjk`` white space goes where CJK characters occur."""
    text = F.regexp_replace(F.coalesce(column(c), F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.when(text.rlike("[一-鿿]"), compact(text)).otherwise(text) if join_cjk else text


def content_hash(c: Column | str) -> Column:
    return F.sha2(column(c), 256)


def rank(*parts: Column | str) -> Column:
    """A seeded order: the hash of the parts joined by colons. Hex digests sort as numbers do."""
    return F.sha2(F.concat_ws(":", *[column(p).cast("string") for p in parts]), 256)


def pick(n: int, *parts: Column | str) -> Column:
    """A stable index below ``n``: the first eight hex digits of ``rank`` modulo n."""
    return F.pmod(F.conv(F.substring(rank(*parts), 1, 8), 16, 10).cast("bigint"), F.lit(n)).cast("int")


def share(*parts: Column | str) -> Column:
    """The first fifteen hex digits of ``rank`` as a number below 2 ** 60."""
    return F.conv(F.substring(rank(*parts), 1, 15), 16, 10).cast("bigint")


def canonical_json(c: Column | str) -> Column:
    """JSON text with sorted keys and no blanks; null if it can't be parsed."""
    return F.to_json(F.try_parse_json(column(c)))


def transcript(turns: Column | str, role: str = "role", text: str = "text", labels: dict[str, str] | None = None) -> Column:
    """``role:text`` lines of an array of turns, roles renamed by ``labels``."""

    def line(t: Column) -> Column:
        name = t[role]
        if labels:
            pairs = [F.lit(x) for kv in labels.items() for x in kv]
            name = F.coalesce(F.element_at(F.create_map(*pairs), name), name)
        return F.concat(name, F.lit(":"), t[text])

    return F.array_join(F.transform(column(turns), line), "\n")


def dotted(document: Column | str, path: str) -> Column:
    """Value at a dotted path of JSON text as canonical JSON; null if any part is missing."""
    steps = "".join(f"['{p}']" for p in path.split("."))
    return F.to_json(F.try_variant_get(F.try_parse_json(column(document)), f"${steps}", "variant"))
