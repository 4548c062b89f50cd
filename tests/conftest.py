import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from newslab.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session()


@pytest.fixture(scope="session")
def day():
    """Consecutive days: day(1) is the first."""
    return lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n - 1)


@pytest.fixture(scope="session")
def plan():
    def text(df, final=False):
        if final:
            df.write.format("noop").mode("overwrite").save()
        return df._jdf.queryExecution().executedPlan().toString()

    return text
