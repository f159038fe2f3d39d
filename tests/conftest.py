import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from compare import SMALLEST  # noqa: E402
from hearthspark.plans.jobs import Workspace  # noqa: E402
from hearthspark.session import local_session  # noqa: E402

@pytest.fixture(scope="session")
def spark():
    return local_session("8", "8")


@pytest.fixture(scope="session")
def ws(spark):
    return Workspace(spark, SMALLEST)
