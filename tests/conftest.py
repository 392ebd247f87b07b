import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from quarry.session import local_session
    s = local_session("*", shuffle_partitions=8, extra={
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="quarry-test-ckpt-")})
    yield s
    s.stop()
