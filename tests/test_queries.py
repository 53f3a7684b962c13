"""Every registered query against its SQL on the smallest data set."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.compare import compare, connect
from workload.base import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    same, note = compare(spark, duck, queries()[name], oracle_sql().get(name), SF_DIR)
    assert same, note


def test_entry(spark):
    assert entry(spark).count() == 64


def test_sql_belongs_to_queries():
    assert set(oracle_sql()) <= set(queries())
