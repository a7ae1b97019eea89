import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("OMP_NUM_THREADS", "1")


@pytest.fixture(scope="session")
def spark():
    from wattline.session import build_session

    session = build_session(
        "tests",
        **{"spark_master": "local[4]", "spark_sql_shuffle_partitions": "4", "spark_ui_enabled": "false", "spark_ui_showConsoleProgress": "false", "spark_driver_memory": "3g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
