import sys
import warnings

import pytest

sys.path.insert(0, "/root/repo")
warnings.filterwarnings("ignore")


@pytest.fixture(scope="session")
def spark():
    from ballast.session import local_session

    session = local_session("8", 8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
