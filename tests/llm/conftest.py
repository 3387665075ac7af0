import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def documents(spark):
    """A frame of documents from (doc_id, text) pairs, with further columns whose names operators use themselves."""

    def make(rows):
        frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
        extra = {name: F.lit("x") for name in ("row", "key", "n", "score", "value", "chunk", "piece", "token", "count", "place", "kind", "_stay")}
        return frame.withColumns(extra).repartition(3)

    return make
