import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]


@pytest.fixture(scope="session")
def spark():
    from loomtrace.session import local_session

    s = local_session(os.environ.get("TEST_CPUS", "8"), "tests")
    yield s
    s.stop()
