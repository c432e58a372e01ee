from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from waitwright.session import local_session

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    return local_session(8, "tests", "8g", str(tmp_path_factory.mktemp("scratch")))


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture
def table(spark):
    """Small table from a schema string and rows."""
    return lambda schema, rows: spark.createDataFrame(rows, schema)
