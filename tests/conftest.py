import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)
TESTS = os.path.dirname(os.path.abspath(__file__))
if TESTS not in sys.path:
    sys.path.insert(0, TESTS)


@pytest.fixture(scope="session")
def spark():
    from churnlens.session import ensure_checkpoint_dir, get_spark
    s = get_spark("local[4]", 8)
    ensure_checkpoint_dir(s)
    yield s
