import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from lumenfold.session import get_session

    s = get_session(
        "tests", "local[4]", 4,
        **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
