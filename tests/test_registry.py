"""Every registered query with SQL gives the rows that DuckDB gives."""

from collections import Counter

import duckdb
import pytest

from graphloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def same(value):
    return round(value, 4) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = registry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = Counter(tuple(same(x) for x in r) for r in df.select(*cols).collect())
    out = duck.sql(registry.oracle_sql()[name])
    assert sorted(out.columns) == cols
    at = [out.columns.index(c) for c in cols]
    assert got == Counter(tuple(same(r[i]) for i in at) for r in out.fetchall())
    assert got


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
