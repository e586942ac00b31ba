import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from recordlake.session import local_session
    return local_session("4", "recordlake-tests")


@pytest.fixture
def rows(spark):
    """Rows of values under a DDL schema."""
    return lambda data, schema: spark.createDataFrame(data, schema)
