"""Each catalog query against DuckDB on the same tables."""

import math

import duckdb
import pytest

from tessera.plans.catalog import QUERIES, SQL

DATA = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: round(v, 5) if isinstance(v, float) and not math.isnan(v) else v
    return sorted(columns), sorted((tuple(clean(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, db, name):
    df = QUERIES[name](spark, DATA)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = db.sql(SQL[name])
    want = rows_of(rel.columns, rel.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]
