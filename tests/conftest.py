import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from motorfisc.session import local_session

    session = local_session(4, "tests", 4)
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    return session


@pytest.fixture(scope="session")
def sf_dir():
    path = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not Path(path).exists():
        pytest.skip("the given tables aren't here")
    return path
