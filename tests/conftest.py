import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from skeinlake.session import build_session

    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    s = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "3g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")), "spark.ui.showConsoleProgress": "false", "spark.sql.autoBroadcastJoinThreshold": "256k",
    })
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
