import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from codemem.session import local_session  # noqa: E402

SF_DIR = os.environ.get("CODEMEM_TEST_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "codemem-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF_DIR):
        pytest.skip(f"no tables at {SF_DIR}")
    return SF_DIR


@pytest.fixture
def frame(spark):
    """Small DataFrame from rows and a DDL schema."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)


@pytest.fixture
def plan():
    """Text of the physical plan chosen before execution."""
    return lambda df: df._jdf.queryExecution().executedPlan().toString()
