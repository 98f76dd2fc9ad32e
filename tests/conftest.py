import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from mcid.session import local_session

    session = local_session(8, "tests", **{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def one(spark):
    """Values of one row of expressions, by name."""

    def run(**columns):
        return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict()

    return run
