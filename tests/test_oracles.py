"""Each clinical query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from medloom.plans import registry

NAMES = sorted(registry.QUERIES)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for name in os.listdir(small):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{small}/{name}'")
    return con


def plain(value):
    return round(value, 9) if isinstance(value, float) else tuple(value) if isinstance(value, list) else value


@pytest.mark.parametrize("name", NAMES)
def test_rows(spark, duck, small, name):
    got = registry.QUERIES[name](spark, small)
    columns = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str)
    assert rows, "a query without rows proves nothing"
    if name in registry.ORACLE_SQL:
        found = duck.execute(registry.ORACLE_SQL[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert rows == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=str)


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)
