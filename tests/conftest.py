"""One local session for all tests."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from shoebox import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    root = tmp_path_factory.mktemp("shared")
    found = session.build(
        "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.checkpoint.dir": f"file://{root}/checkpoints", "spark.sql.warehouse.dir": f"{root}/warehouse", "spark.driver.memory": "4g"},
    )
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()
