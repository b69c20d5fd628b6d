"""Every registered query that SQL can express agrees with its SQL on the smallest given tables."""

import os

import pytest

import __spark_entry__ as contract
from auditspark.plans import queries as registered
from compare import database, differences

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def connection():
    return database(SF_DIR)


def test_every_audit_query_has_sql():
    assert set(registered.all_queries()) <= set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", list(contract.oracle_sql()))
def test_query_agrees_with_sql(spark, connection, name):
    assert differences(spark, connection, SF_DIR, name) == []


def test_entry(spark):
    assert contract.entry(spark).limit(1).count() == 1
