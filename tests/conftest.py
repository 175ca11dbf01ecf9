import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PEAKFORGE_DRIVER_MEMORY", "4g")

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from peakforge.session import get_spark

    return get_spark("tests", cores=4, partitions=4)


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    return DATA
