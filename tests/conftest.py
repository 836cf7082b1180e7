import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("TOLQYN_SHUFFLE", "4")


@pytest.fixture(scope="session")
def spark():
    from tolqyn.session import get_session

    session = get_session("tests", "local[4]", spark__driver__memory="4g", spark__sql__warehouse__dir="/tmp/tolqyn-warehouse")
    yield session


DATA = os.environ.get("TOLQYN_TEST_DATA", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def data():
    if not Path(DATA).exists():
        pytest.skip("no test tables here")
    return DATA
