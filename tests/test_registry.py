"""Every registered query of the library's own operators against its SQL, on the smallest driver tables."""

import os

import pytest

from braidlake.plans import registry

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in ("events", "embeddings", "region"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(round(float(r[i]), 9) if isinstance(r[i], float) else r[i] for i in order) for r in values], key=str)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sql, name):
    got = registry.queries()[name](spark, DATA)
    if name not in registry.oracle_sql():
        assert got.count() > 0
        return
    want = sql.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
