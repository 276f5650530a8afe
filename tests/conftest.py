import functools
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from spectralake.session import build_session, ship  # noqa: E402
from workload import queries  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    # calibration tables are the same for every query: build each once
    for name in ("_calibration", "_image_sums"):
        setattr(queries, name, functools.lru_cache(getattr(queries, name)))
    yield session
    session.stop()
