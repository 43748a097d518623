import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from concourse.session import build_session, shared_dir
    s = build_session("local[4]", 8, app_name="concourse-tests")
    shared_dir(s)  # tests set their own shared folder (the session has none)
    yield s
    s.stop()
