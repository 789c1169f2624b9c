"""Every registered query of the library runs, and agrees with its SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from tessella.plans.catalog import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.sql(f"create view {os.path.basename(path).removesuffix('.parquet')} as select * from '{path}'")
    return connection


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, tables, name):
    got = QUERIES[name](spark, FOLDER)
    rows = got.collect()
    if name not in SQL:
        return
    want = tables.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    at = [want.columns.index(c) for c in columns]
    ours = sorted(((tuple(plain(r[c]) for c in columns)) for r in rows), key=repr)
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert ours == theirs


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
