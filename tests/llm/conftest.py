import pytest


@pytest.fixture
def docs_of(spark):
    """A table of documents from texts, with ids from 0 and clashing extra columns."""

    def make(texts, partitions=3):
        rows = [(i, t, "en", i % 2) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, kept string, score int").repartition(partitions)

    return make
