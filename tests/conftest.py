import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

from sparktext.session import get_session


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tiny(spark):
    """Three documents, two classes (0 = A, 1 = B)."""
    rows = [(1, "cat dog", 0), (2, "cat cat", 0), (3, "dog fish", 1)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, label int")
