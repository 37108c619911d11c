import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from signpost.session import local_session  # noqa: E402


# Started here, so that test modules may build column literals while they are imported.
SESSION = local_session("signpost-tests", cpus=8, shuffle_partitions=4)


@pytest.fixture(scope="session")
def spark():
    return SESSION


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
