import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from parley.session import local_session  # noqa: E402

FIXTURES = Path(__file__).resolve().parent / "fixtures"


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def messages_path():
    return str(FIXTURES / "messages.csv")


@pytest.fixture(scope="session")
def second_opinion_path():
    return str(FIXTURES / "second_opinion.csv")
