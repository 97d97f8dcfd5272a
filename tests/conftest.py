import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from skysift.session import get_session, prepared

    s = prepared(get_session("local[4]", 4, "4g"))
    s.sparkContext.setLogLevel("ERROR")
    return s
