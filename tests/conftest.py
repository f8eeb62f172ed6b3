import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "scripts")]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from provalake.session import local_session

    session = local_session("tests", **{"spark.sql.streaming.stateStore.providerClass":
                                        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
