"""Every query with SQL gives DuckDB's rows; the others give rows."""

import os

import pytest
from conftest import plain, rows_of

import siftwork.plans.registry as registry


@pytest.fixture(scope="module")
def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, duck, name):
    columns, got = rows_of(registry.QUERIES[name](spark, sf_dir))
    if name not in registry.ORACLE:
        assert got
        return
    r = duck.sql(registry.ORACLE[name])
    assert sorted(r.columns) == columns
    at = [r.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=str)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
