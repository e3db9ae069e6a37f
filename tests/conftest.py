import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from sigtok.session import build  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build("local[4]", 4, **{"spark.driver.memory": "4g", "spark.sql.execution.arrow.maxRecordsPerBatch": "500"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    if not Path(DATA).is_dir():
        pytest.skip("no test data")
    return DATA
