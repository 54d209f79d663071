import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

from maskfold.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, "6g", "tests")
    s.sparkContext.setLogLevel("OFF")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    return s
