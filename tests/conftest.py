import pytest

from sieveline.session import session


@pytest.fixture(scope="session")
def spark():
    s = session(8)
    s.sparkContext.setLogLevel("ERROR")
    return s
