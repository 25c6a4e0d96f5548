import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from clauseloom.session import build_session, release  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", **{"spark.ui.showConsoleProgress": "false"})
    yield session
    release(session)
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR
