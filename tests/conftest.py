import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from hustings.session import session

    base = tmp_path_factory.mktemp("spark")
    s = session("local[4]", 4, "tests", **{"spark.driver.memory": "4g", "spark.ui.enabled": "false", "spark.sql.warehouse.dir": str(base / "warehouse"), "spark.checkpoint.dir": str(base / "shared"), "spark.driver.host": "127.0.0.1"})
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
