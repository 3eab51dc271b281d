import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from assayer.session import get_spark, release  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_spark("tests", "local[8]", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    release(s)
    s.stop()
