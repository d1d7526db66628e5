import pytest

from awkward_rows import AWKWARD, SCHEMA


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, "w", "y") for i, t in AWKWARD], SCHEMA)


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)
