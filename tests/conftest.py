import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent
for folder in (ROOT, ROOT / "tests"):
    if str(folder) not in sys.path:
        sys.path.insert(0, str(folder))

from docuvet.session import local_session
from docuvet.streaming.liveness import STATE_STORE


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", 4, "8g")
    for key, value in STATE_STORE.items():
        session.conf.set(key, value)
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate expressions over one row of named string values."""

    def run(values, *columns):
        schema = ", ".join(f"{k} string" for k in values)
        return tuple(spark.createDataFrame([tuple(values.values())], schema).select(*columns).first())

    return run
