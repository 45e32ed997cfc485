import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from quernstone.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, memory="4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    if not Path(SMALL).exists():
        pytest.skip("no test tables here")
    return SMALL


@pytest.fixture
def one(spark):
    """The value of a column function for one text (or other value)."""

    def run(function, value, kind="string"):
        return spark.createDataFrame([(value,)], f"v {kind}").select(function("v").alias("r")).first()["r"]

    return run
