import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from postmill.session import get_session
    s = get_session("local[4]", 4, app_name="postmill-tests")
    yield s


@pytest.fixture
def tmpdir_path(tmp_path):
    return str(tmp_path)
