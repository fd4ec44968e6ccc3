import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from dataweft.session import get_spark  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = get_spark("local[8]", "tests", 4, **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                                                   "spark.driver.memory": "8g", "spark.sql.maxMetadataStringLength": "2000"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


def rows(df, *cols):
    return sorted((tuple(r[c] for c in (cols or df.columns)) for r in df.collect()),
                  key=lambda t: tuple((x is not None, str(type(x)), x) if not isinstance(x, (list, dict)) else (True, "", str(x)) for x in t))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
