"""Every registered query against its SQL, at the smallest scale unless CHECK_SF_DIR is set."""

import os

import pytest
from compare import difference, duck

import __spark_entry__ as entry
from stellwerk.checks import ORACLES, QUERIES

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, connection, name):
    frame = entry.queries()[name](spark, SF_DIR)
    assert difference(frame, connection, entry.oracle_sql()[name]) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES) <= set(entry.oracle_sql())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
