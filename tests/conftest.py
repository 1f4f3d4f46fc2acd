import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from barloom.session import local_session, prepare  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = prepare(local_session(8, "barloom-tests"))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
