"""Every query with SQL gives what DuckDB gives; the others give rows."""

import math

import duckdb
import pytest

from corpusmill import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    got = [tuple(map(plain, r)) for r in df.select(sorted(df.columns)).collect()]
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    found = db.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    at = [columns.index(c) for c in sorted(columns)]
    want = [tuple(plain(r[i]) for i in at) for r in found.fetchall()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert got or name in ("context_pack", "entry_page", "queue_missing_items", "no_active_run")
