"""Every registered query against its SQL on DuckDB: names, row counts and values."""

import math
import os

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from rarefind.plans.queries import REGISTRY

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


# The smallest tables have 32 rare rows to test a model on, too few to judge a share against a floor.
QUALITY_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def _duck(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return connection


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def _cell(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def _canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def test_every_query_has_sql():
    assert set(REGISTRY) <= set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, sf_dir, name):
    sql = oracle_sql()[name]
    folder = QUALITY_DIR if "quality_ok" in sql else sf_dir
    ours = queries()[name](spark, folder)
    theirs = _duck(folder).execute(sql)
    their_columns = [d[0] for d in theirs.description]
    assert sorted(ours.columns) == sorted(their_columns)
    their_types = {d[0]: str(d[1]) for d in theirs.description}
    assert {c: TYPES[t] for c, t in ours.dtypes} == their_types
    left = _canonical(ours.columns, ours.collect())
    right = _canonical(their_columns, theirs.fetchall())
    assert len(left) == len(right)
    assert left == right
