import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from citeflow.session import get_spark
    s = get_spark(master="local[2]", app="citeflow-tests", shuffle_partitions=4)
    yield s


@pytest.fixture
def tmp_dir(tmp_path):
    return str(tmp_path)
