import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from quire.runtime import session, ship

    made = session("quire-tests", "4", partitions=4, memory="4g")
    made.sparkContext.setLogLevel("ERROR")
    yield ship(made)
    made.stop()


@pytest.fixture(scope="session")
def data():
    folder = Path("/root/testdata/sf0.001")
    if not folder.exists():
        pytest.skip("the test tables are not here")
    return str(folder)
