import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from areaframe.session import get_session  # noqa: E402

DATA = os.environ.get("TEST_DATA_DIR", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "tests",
        "local[8]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="4g",
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def tiny():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.01"


def rows(df, *order):
    """Collected rows as tuples, sorted (missing first) unless an order is given."""
    listed = [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
    return listed if order else sorted(listed, key=lambda r: [(x is not None, str(x)) for x in r])
