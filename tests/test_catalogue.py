"""Every catalogue query against its SQL, on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = {k: f for part in entry.CATALOGUES for k, f in part.Q.queries.items()}
SQL = {k: s for part in entry.CATALOGUES for k, s in part.Q.sql.items()}

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def value(v):
    if v is None:
        return "null"
    if isinstance(v, float) and not math.isnan(v):
        return repr(round(v, 6) + 0.0)
    return v.isoformat() if hasattr(v, "isoformat") else repr(v)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(value(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(OWN))
def test_matches_sql(spark, con, name):
    df = OWN[name](spark, DATA)
    want = con.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, want.fetchall())


def test_every_query_has_sql():
    assert set(OWN) == set(SQL)
