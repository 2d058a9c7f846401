"""Registered queries against their SQL on the smallest given tables."""

import os

import pytest

import __spark_entry__ as entry
from check_oracles import compare, duck
from larder.catalogue.oracles import ORACLES
from larder.catalogue.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    difference, rows, _, _ = compare(
        spark, con, FOLDER, name, QUERIES[name], ORACLES[name])
    assert difference is None
    assert rows > 0
