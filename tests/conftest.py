import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from capturelake.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("capturelake-tests")
    yield session
    session.stop()
