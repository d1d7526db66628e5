"""Every query with SQL gives what DuckDB gives; results don't depend on partitions."""

import glob
import os

import duckdb
import pytest

from curatrix.plans import catalogue

SF = "/root/testdata/sf0.001"


def rows(found, names):
    def plain(v):
        return round(v, 6) if isinstance(v, float) else v

    return sorted((tuple(plain(r[names.index(n)]) for n in sorted(names)) for r in found), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


#: At this scale the scarcest bucket is another one, or a bucket is too small.
OTHER_SCALE = {"quality_select_margin"}


@pytest.mark.parametrize("name", sorted(set(catalogue.ORACLE_SQL) - OTHER_SCALE))
def test_query_against_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    rel = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    from decimal import Decimal

    want = [tuple(float(v) if isinstance(v, Decimal) else v for v in r) for r in rel.fetchall()]
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(want, list(rel.columns))


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_without_sql_is_repeatable_over_partitions(spark, name):
    got = []
    for n in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        df = catalogue.QUERIES[name](spark, SF)
        got.append(rows([tuple(r) for r in df.collect()], df.columns))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got[0] == got[1]


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0
    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
