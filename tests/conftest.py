import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from gleaner.session import local_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests")
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    for module in Path(__file__).parent.glob("test_*.py"):
        session.sparkContext.addPyFile(str(module))  # stand-in generators live there
    yield session
    session.stop()
