import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("FOOTFALL_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from footfall.session import build_session

    work = tmp_path_factory.mktemp("work")

    session = build_session(
        "footfall-tests",
        master="local[8]",
        shuffle_partitions=8,
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(work / "shared"),
            "spark.sql.warehouse.dir": str(work / "warehouse"),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data_root():
    if not os.path.isdir(DATA):
        pytest.skip("test tables not present")
    return DATA


def plan_text(df):
    """Physical plan as text."""
    return df._jdf.queryExecution().executedPlan().toString()
