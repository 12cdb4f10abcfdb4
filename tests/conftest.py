from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from perfsieve.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def tuned(spark):
    """Set perfsieve tuning values for one test: tuned(heavyRows=4)."""
    names = []

    def apply(**values):
        for name, value in values.items():
            spark.conf.set(f"perfsieve.{name}", str(value))
            names.append(f"perfsieve.{name}")

    yield apply
    for name in names:
        spark.conf.unset(name)
