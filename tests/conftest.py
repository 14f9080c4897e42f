import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]


@pytest.fixture(scope="session")
def spark():
    from bench import session

    s = session("4")
    yield s
    s.stop()


@pytest.fixture
def plan():
    """Final physical plan of a frame, after it has run."""

    def of(df):
        df.collect()
        text = df._jdf.queryExecution().executedPlan().toString()
        return text.split("== Initial Plan ==")[0]

    return of
