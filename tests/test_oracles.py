"""Every registered query against its SQL counterpart on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tools.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    if name in ORACLES:
        problem = compare(got, duck.execute(ORACLES[name]).df())
        assert problem is None, problem
    else:
        assert len(got) > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
