import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from buildlens.operators.timeline import HOT_ROWS_SETTING  # noqa: E402
from buildlens.session import local_session  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark():
    return local_session(8)


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def duck(sf_dir):
    import oracle

    return oracle.connect(sf_dir)


@pytest.fixture
def sliced(spark):
    """Force the sliced paths by calling a few hundred rows a large key."""
    spark.conf.set(HOT_ROWS_SETTING, "300")
    yield
    spark.conf.unset(HOT_ROWS_SETTING)
