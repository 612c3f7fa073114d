from __future__ import annotations

import pytest

from tests.session import session


@pytest.fixture(scope="session")
def spark():
    return session()


@pytest.fixture
def large_sides(spark):
    """Make every looked-up side count as too large to broadcast."""
    spark.conf.set("spark.tradewinds.broadcastInputBytes", "0")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.tradewinds.broadcastInputBytes")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
