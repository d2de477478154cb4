import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tutelage.session import local_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, memory="4g", **{"spark.sql.shuffle.partitions": "2"})
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture
def in_range_parts(request, spark):
    """Ranges are dealt into as many parts as the test's ``parts`` says, however few the rows."""
    parts = request.node.callspec.params["parts"]
    changed = {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    yield parts
    for k, v in before.items():
        spark.conf.set(k, v)
