"""Every query of the plans against its SQL in DuckDB on the smallest tables."""

import duckdb
import pytest

from quarry.plans import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def told(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    return f"{float(value):.4f}" if isinstance(value, (int, float)) else str(value)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, duck, name):
    found = queries.QUERIES[name](spark, DATA)
    want = duck.execute(queries.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(found.columns) == sorted(columns)
    ours = sorted(tuple(told(r[c]) for c in columns) for r in found.collect())
    theirs = sorted(tuple(told(v) for v in r) for r in want.fetchall())
    assert ours == theirs


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.SQL)
