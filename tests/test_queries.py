from __future__ import annotations

import pytest

import quire.plans  # noqa: F401
from quire.registry import FLAGSHIP, ORACLES, QUERIES
from tests.oracle import same_rows

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    same_rows(spark, QUERIES[name], ORACLES[name], FOLDER)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_flagship():
    assert FLAGSHIP in QUERIES
