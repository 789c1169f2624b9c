"""The training-data queries run by name on the smallest tables, and those with SQL agree with it."""

import glob
import os

import duckdb
import pytest

from tessella.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(SQL))
def test_agrees_with_its_sql(spark, name):
    tables = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        tables.sql(f"create view {os.path.basename(path).removesuffix('.parquet')} as select * from '{path}'")
    got, want = QUERIES[name](spark, FOLDER), tables.sql(SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    theirs = [tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall()]
    assert theirs
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted(theirs, key=repr)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).limit(1).count() == 1
