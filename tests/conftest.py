import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from textloom.session import local_session

    session = local_session(os.environ.get("TEST_CPUS", "8"), memory="4g", app="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
