from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from tally.session import build_session, ensure_checkpoint_dir
    s = build_session("local[*]", app="tally-tests", shuffle_partitions=8)
    ensure_checkpoint_dir(s)  # local scratch folder: tests only
    yield s
    s.stop()


@pytest.fixture()
def no_broadcast(spark):
    """Plan as on a cluster where no dimension fits a broadcast."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("tally.broadcast.maxBytes", "0")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("tally.broadcast.maxBytes")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
