"""Every query of the library against its SQL on the smallest test scale, those on fixed rows too."""

import math

import duckdb
import pytest

from brakta import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) and math.isfinite(v) else v


def rows_of(columns, records):
    return sorted((tuple(plain(r[c]) for c in columns) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ALL_SQL))
def test_same_as_sql(spark, data, duck, name):
    df = registry.ALL[name](spark, data)
    columns = sorted(df.columns)
    got = rows_of(columns, df.collect())
    want = duck.sql(registry.ALL_SQL[name])
    assert sorted(want.columns) == columns
    names = list(want.columns)
    assert got == rows_of(columns, [dict(zip(names, r, strict=True)) for r in want.fetchall()])


@pytest.mark.parametrize("name", sorted(set(registry.ALL) - set(registry.ALL_SQL)))
def test_runs(spark, data, name):
    assert registry.ALL[name](spark, data).count() > 0
