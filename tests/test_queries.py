"""Every query with an oracle against DuckDB, on the smallest tables."""

import duckdb
import pytest

from millrace import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 8)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("key", sorted(registry.ORACLES))
def test_same_rows_as_the_oracle(spark, duck, key):
    df = registry.QUERIES[key](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    asked = duck.execute(registry.ORACLES[key])
    names = [d[0] for d in asked.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in asked.fetchall()), key=repr)


@pytest.mark.parametrize("key", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_rows_without_an_oracle(spark, key):
    assert registry.QUERIES[key](spark, SF).count() > 0
