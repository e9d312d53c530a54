import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from attestry.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("8", "tests")


@pytest.fixture
def frame(spark):
    """A DataFrame from rows and a schema text, in several partitions."""

    def make(rows, schema):
        return spark.createDataFrame(rows, schema).repartition(3)

    return make
