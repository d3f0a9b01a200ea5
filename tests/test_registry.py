"""Every registered query against its SQL, on the smallest tables."""

import glob
import os

import __spark_entry__ as entry
import duckdb
import pytest

from lodestar.plans import registry


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(df):
    return sorted(tuple(map(str, r)) for r in df[sorted(df.columns)].astype(str).values.tolist())


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(name, spark, sf, duck):
    got = registry.QUERIES[name](spark, sf).toPandas()
    if name in registry.ORACLES:
        want = duck.sql(registry.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
