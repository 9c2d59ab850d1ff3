import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from boardsift.session import local_session  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, memory="4g", app="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture
def value(spark):
    """Evaluate ``fn(column)`` over a list of strings."""
    from pyspark.sql import functions as F

    def run(fn, inputs, schema="i INT, x STRING"):
        df = spark.createDataFrame(list(enumerate(inputs)), schema)
        return [r[0] for r in df.orderBy("i").select(fn(F.col("x"))).collect()]

    return run
