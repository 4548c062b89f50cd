"""Every registered query against its SQL text, at the smallest scale."""

import pytest

import __spark_entry__ as entry
from catalog.registry import ORACLES, QUERIES
from tests.check_catalog import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    assert compare(spark, con, name, FOLDER) is None


def test_every_query_of_the_catalog_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
