import pytest

from tessella.session import build_session


@pytest.fixture(scope="session")
def spark():
    return build_session(master="local[4]", partitions=4)
