import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from promptsieve.session import build_session


@pytest.fixture(scope="session")
def texts(spark):
    """n rows of (row_id, text) from a given key on, with several sentences each."""
    def build(n, first=0):
        words = ("harbour", "violin", "meadow", "lantern", "granite", "willow", "copper")
        part = lambda i, k: " ".join(f"{words[(i + j) % 7]}{(i * 31 + k * 17 + j * j) % 211}" for j in range(5)) + f" {i % 97}{k}"
        return spark.createDataFrame([(i, ". ".join(part(i, k) for k in range(4)) + ".") for i in range(first, first + n)],
                                     "row_id bigint, text string")
    return build


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[4]", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "4",
        "spark.driver.memory": "6g", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
