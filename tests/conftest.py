import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from mnemospark import build_session  # noqa: E402

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    session = build_session(
        "tests", "local[8]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g", "spark.ui.enabled": "false"}
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def make(spark):
    """``make("id long, name string", [(1, "a")])``"""
    return lambda schema, rows: spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def data() -> str:
    if not DATA.exists():
        pytest.skip("no test data")
    return str(DATA)
