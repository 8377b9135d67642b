import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pairflow.session import local_session  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", memory="6g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def pairs(spark, sf):
    from pairflow.sources import fixtures
    from pairflow.workspace import materialize
    return materialize(fixtures.pairs(spark, sf))


@pytest.fixture(scope="session")
def predictions(spark, pairs):
    from pairflow.sources import fixtures
    from pairflow.workspace import materialize
    return materialize(fixtures.scored(pairs))
