import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from lexmesh.session import local_session

    session = local_session(8, shuffle_partitions=8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    folder = "/root/testdata/sf0.001"
    assert Path(folder).exists(), "the given tables are missing"
    return folder
