import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from packwise.session import local_session, tune  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("PACKWISE_DRIVER_MEMORY", "8g")
    session = local_session("4", "packwise-tests")
    session.sparkContext.setLogLevel("OFF")
    tune(session)
    return session
