import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from gridloom.session import local_session

    os.environ["PYTHONPATH"] = os.path.dirname(os.path.dirname(os.path.abspath(__file__))) + ":" + os.environ.get("PYTHONPATH", "")
    shared = tmp_path_factory.mktemp("shared")
    session = local_session(4, 4, "3g", **{"spark.checkpoint.dir": f"file://{shared}", "spark.sql.warehouse.dir": str(shared / "wh")})
    yield session
    session.stop()
