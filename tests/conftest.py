import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from plainsight.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "tests")


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return DATA


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def values(df, *cols):
    return [tuple(r) for r in (df.select(*cols) if cols else df).collect()]
