"""Queries that SQL can express, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tests.conftest import SMALL
from tests.test_queries import rows
from tokenguard.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, SMALL).toPandas()) == rows(duck.execute(ORACLE_SQL[name]).fetchdf())
