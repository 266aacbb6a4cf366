import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    from skyquilt import session

    s = session.build("tests", "local[8]", 8)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    session.clear(s)
    s.stop()
