import datetime as dt
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fleetlens import config  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    yield config.local_session("*", shuffle_partitions=8, driver_memory="4g", app="fleetlens-tests")


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="fleetlens-test-")


def ts(s: str) -> dt.datetime:
    """Naive UTC datetime from 'YYYY-MM-DD HH:MM:SS[.ffffff]'."""
    return dt.datetime.fromisoformat(s)
