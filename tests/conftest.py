import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

os.environ.setdefault("PARALLAX_WAREHOUSE", tempfile.mkdtemp(prefix="parallax-tests-"))  # one machine

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from parallax.session import get_spark

    s = get_spark("*", 8, "parallax-tests")
    yield s
    s.stop()


@pytest.fixture(autouse=True)
def _released(request):
    """Nothing that a test kept or staged stays for the next one."""
    yield
    if "spark" in request.fixturenames:
        from parallax.caches import release

        release(request.getfixturevalue("spark"))
