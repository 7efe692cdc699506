import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from billrate.session import local_session

    return local_session(8, "billrate-tests")


@pytest.fixture(scope="session")
def sf():
    return SF
