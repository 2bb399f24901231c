import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from loomvec.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session("loomvec-tests", 4, 4)
    yield session
    session.stop()
