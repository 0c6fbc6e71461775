import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from perilweave.session import local_session

    s = local_session("8", name="tests", shared=f"file://{tmp_path_factory.mktemp('shared')}")
    yield s
    s.stop()
