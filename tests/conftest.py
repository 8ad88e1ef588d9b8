import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from pyspark import cloudpickle  # noqa: E402

import gridcast  # noqa: E402
from gridcast.session import build_session  # noqa: E402

cloudpickle.register_pickle_by_value(gridcast)


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]",
        spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="8g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """Rows and a schema text to a DataFrame."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
