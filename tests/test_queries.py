"""Every registered query with SQL gives the same rows as DuckDB over the smallest tables."""

import glob
import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tokenguard import params
from tokenguard.plans import corpus, registry, streams, suites  # noqa: F401


def value(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(value, v)) + "]"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, float, np.integer, np.floating)):
        return repr(float(v))
    return str(v)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(value, r)) for r in frame[columns].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, duck, name):
    assert rows(registry.QUERIES[name](spark, SMALL).toPandas()) == rows(duck.execute(registry.SQL[name]).fetchdf())


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.SQL)


def test_retrieve_text_asks_for_every_user_turn(spark):
    hits = corpus.retrieve_text(spark, SMALL).groupBy("query_id").count().collect()
    asked = spark.read.parquet(f"{SMALL}/conversations.parquet").where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("id")).collect()
    assert {r["query_id"] for r in hits} == {r["id"] for r in asked} and all(r["count"] == params.Retrieval().top_k for r in hits)


def test_draft_logprob_takes_no_join(spark):
    """Turns are short: nothing is there that Spark could broadcast through the driver."""
    plan = streams.draft_logprob(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if line.lstrip(" +:-").startswith("Join ")]
