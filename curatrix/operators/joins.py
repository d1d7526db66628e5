"""Joins of rows with one row for each key, where a few keys may have most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of the rows is met by broadcast; there are no more such keys than its inverse.
LARGE_SHARE = 1e-4


def shuffled(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``left`` and ``right`` joined by a shuffle, whatever Spark takes their sizes for.

    Spark estimates an exploded table from the one it comes from, without the number of rows that each row gives. So a join
    of millions of exploded rows may look small enough to be broadcast, and would pass through the driver.
    """
    return left.join(right.hint("merge"), on, how)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out anew over as many tasks as a shuffle has: for rows that cost far more than their move, as a
    small file comes in one partition."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def met(rows: DataFrame, facts: DataFrame, on: list[str], n: str, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``facts`` that aren't in ``on``; ``facts`` has each key once, and in ``n`` how many rows have it.

    Facts of large keys, few by arithmetic, are broadcast, so their rows stay where they are; all other rows meet theirs
    by a shuffle in which no key is large. Null is a key. ``how`` is inner or left; columns ``on`` have one name on both
    sides, all others differ; ``rows`` is read twice. ``n`` isn't in the result.
    """
    total = facts.agg(F.coalesce(F.sum(n), F.lit(0)).alias("n")).first().n
    named = facts.withColumnsRenamed({c: f"__{c}" for c in on})
    large, small = named.where(F.col(n) > F.lit(total * LARGE_SHARE)), named.where(F.col(n) <= F.lit(total * LARGE_SHARE))
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    columns = [*rows.columns, *[c for c in facts.columns if c not in on and c != n]]
    heavy = rows.join(F.broadcast(large), same).select(*columns)
    rest = rows.join(F.broadcast(large.select(*[f"__{c}" for c in on])), same, "left_anti").join(small, same, how)
    return heavy.unionByName(rest.select(*columns))
