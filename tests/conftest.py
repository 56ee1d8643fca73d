import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from convhist.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "convhist-tests", "6g")


@pytest.fixture(scope="session")
def sf_dir():
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("test tables are not available")
    return path
