"""One Spark session for all tests."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from auditspark.session import tune  # noqa: E402
from compare import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = session("4", "auditspark-tests")
    spark.sparkContext.setLogLevel("ERROR")
    yield tune(spark)
    spark.stop()


@pytest.fixture
def table(spark):
    """Make a DataFrame from rows and a DDL schema."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
