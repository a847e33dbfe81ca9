import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from twinline.columns import ID, SL, SOURCE, TARGET  # noqa: E402
from twinline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4, memory="6g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def pairs(spark):
    """Build a pair table from (id, source, target) rows."""

    def build(*rows):
        numbered = [(i + 1, *row) for i, row in enumerate(rows)]
        return spark.createDataFrame(numbered, f"{SL} bigint, {ID} bigint, {SOURCE} string, {TARGET} string")

    return build
