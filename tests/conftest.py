"""One local session for all tests."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from weftline.session import get_spark

    session = get_spark(4, 4, "4g")
    yield session
    session.stop()
