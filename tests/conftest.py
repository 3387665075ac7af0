import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from stellwerk.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"}
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """Values of a column function over a list of texts, in order."""

    def run(function, texts):
        rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
        result = rows.select("i", function(F.col("t")).alias("v")).collect()
        return [row.v for row in sorted(result, key=lambda row: row.i)]

    return run
