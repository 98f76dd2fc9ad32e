import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def docs(spark):
    from cases import awkward, frame

    return frame(spark, awkward()).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    from cases import frame

    return frame(spark, [])
