"""The registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
from ledgerlens.plans import registry

SF = "/root/testdata/sf0.001"


def plain(x):
    return None if x is None or x != x else round(x, 5) if isinstance(x, float) else x


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in ("events", "documents", "embeddings"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, db, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=str)
    rel = db.sql(registry.oracle_sql()[name])
    at = [rel.columns.index(c) for c in cols]
    assert sorted(rel.columns) == cols
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
