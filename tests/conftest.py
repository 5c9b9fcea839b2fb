import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"  # for the Python workers
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    from tidewire.session import local_session

    return local_session(4, memory="4g", spark__sql__shuffle__partitions="4")


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
