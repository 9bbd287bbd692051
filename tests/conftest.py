import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tessella.plans.session import make_session

    s = make_session("tests", master="local[4]", warehouse=str(tmp_path_factory.mktemp("warehouse")))
    yield s
    s.stop()
