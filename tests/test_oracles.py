"""Every query with SQL gives the same rows in Spark and DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    fix = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(fix(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) & set(entry.queries())))
def test_same_rows(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    cur = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    want = canonical(cur.fetchall(), names)
    assert sorted(df.columns) == sorted(names)
    assert got == want


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
