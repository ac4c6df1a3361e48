import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from locusframe.session import session

    s = session("local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
