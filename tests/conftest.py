import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from carelens.session import build_session

    ckpt = tempfile.mkdtemp(prefix="carelens-test-ckpt-", dir="/tmp")
    s = build_session("local[4]", app_name="carelens-tests", conf={
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.checkpoint.dir": ckpt,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="carelens-test-warehouse-", dir="/tmp"),
    })
    yield s
    s.stop()


@pytest.fixture()
def workdir():
    return tempfile.mkdtemp(prefix="carelens-test-", dir="/tmp")


SF_SMALL = "/root/testdata/sf0.001"
