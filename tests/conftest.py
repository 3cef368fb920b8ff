import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))



@pytest.fixture(scope="session")
def spark():
    from querywarden.session import build_session

    s = build_session("local[4]", 8, app_name="querywarden-tests")
    yield s
    s.stop()
