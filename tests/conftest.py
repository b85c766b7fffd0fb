import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from hanok.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 4, spark__sql__shuffle__partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """Small literal tables: rows as dicts, missing keys null, all columns text unless a schema is given."""

    def make(rows, schema=None):
        if schema is None:
            names = list(dict.fromkeys(k for r in rows for k in r))
            schema = ", ".join(f"`{n}` string" for n in names)
            rows = [[None if r.get(n) is None else str(r[n]) for n in names] for r in rows]
        return spark.createDataFrame(rows, schema)

    return make
