import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])


@pytest.fixture(scope="session")
def spark():
    from gridjobs.session import session

    place = tempfile.mkdtemp(prefix="gridjobs-test-")
    s = session("local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g", spark__sql__warehouse__dir=f"{place}/warehouse", spark__local__dir=place)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
