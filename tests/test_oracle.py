"""Every query with SQL gives that SQL's rows."""

from __future__ import annotations

import os

import pytest

from tessera.plans import all_queries

duckdb = pytest.importorskip("duckdb")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    c.sql("set TimeZone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, sf_dir, db, name):
    query, sql = all_queries()[name]
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if sql is None:
        assert columns
        return
    relation = db.sql(sql)
    assert sorted(relation.columns) == columns
    assert not [t for t in map(str, relation.types) if t == "HUGEINT" or t.startswith("DECIMAL")]
    at = [relation.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=repr)
