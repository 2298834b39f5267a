import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from trainframe.session import build_session

    s = build_session("tests", "local[8]", 8)
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    return s
