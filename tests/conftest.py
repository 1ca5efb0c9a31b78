from __future__ import annotations

import pytest

from barlake.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session("local[4]", 4, "tests", {"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")), "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
