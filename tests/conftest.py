import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from gatehouse.session import build_session

    session = build_session("tests", "local[4]", 4, **{"spark.driver.memory": "6g"})
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows(spark):
    """``rows(values)`` -> DataFrame ``id, x``."""
    return lambda values: spark.createDataFrame(list(enumerate(values)), "id int, x string")
