import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("stage")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


HAND_ROWS = [
    (1, "a", "x", "p", "yes"),
    (2, "a", "x", "q", "yes"),
    (3, "a", "y", "p", "yes"),
    (4, "a", "y", "q", "no"),
    (5, "b", "x", "p", "no"),
    (6, "b", "x", "q", "no"),
    (7, "b", "y", "p", "yes"),
    (8, "b", "y", "p", "no"),
    (9, "a", "x", "p", "yes"),
    (10, "b", "y", "q", "no"),
    (11, "a", "y", None, "no"),
    (12, "b", "x", "q", "yes"),
    (13, "a", "x", "q", "no"),
    (14, "b", "y", "p", "no"),
]


@pytest.fixture(scope="session")
def hand(spark):
    return spark.createDataFrame(HAND_ROWS, "id int, c1 string, c2 string, c3 string, y string").cache()


@pytest.fixture(scope="session")
def hand_model(hand):
    import kadence as kd

    structure = kd.learn_structure(hand, "y", 2, exclude=["id"]).cache()
    model = kd.learn_parameters(hand, structure)
    return model, structure, kd.compile_model(model, structure)
