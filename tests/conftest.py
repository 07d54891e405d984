import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fleetlens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(min(8, os.cpu_count() or 4), "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
