import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from postwatch.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", 4, **{"spark.ui.enabled": "false", "spark.driver.memory": "6g",
                                              "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture
def one(spark):
    """Evaluate a column on a single text."""

    def run(text, fn):
        frame = spark.createDataFrame([(text,)], "t STRING")
        return frame.select(fn("t").alias("x")).first()["x"]

    return run
