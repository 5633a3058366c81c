import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from structaudit.session import local_session

    session = local_session("tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def evaluated(spark):
    """Evaluate column expressions over rows: evaluated(rows, schema, name=column, ...)."""

    def run(rows, schema, **columns):
        df = spark.createDataFrame(rows, schema)
        return [r.asDict(recursive=True) for r in df.select(*[c.alias(n) for n, c in columns.items()]).collect()]

    return run
