"""Every registered query of the operations against DuckDB on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from weftline import atlas, star, stores

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    return str(v) if isinstance(v, (datetime.date, datetime.datetime)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def compare(module, spark, duck, name):
    df = module.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((repr([plain(r[c]) for c in columns]) for r in df.collect()))
    cursor = duck.execute(module.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in cursor.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(star.queries()))
def test_query(spark, duck, name):
    compare(star, spark, duck, name)


@pytest.mark.parametrize("name", sorted(atlas.queries()))
def test_query_of_domains_made_from_tables(spark, duck, name):
    compare(atlas, spark, duck, name)


@pytest.mark.parametrize("name", sorted(stores.queries()))
def test_query_over_a_store(spark, duck, name):
    compare(stores, spark, duck, name)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["o_orderkey", "o_totalprice"]
    assert set(star.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
