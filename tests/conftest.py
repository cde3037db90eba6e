import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tabulant.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[*]", app_name="tabulant-tests", shuffle_partitions=8,
                      extra={"spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="tabulant-test-wh-")})
    # spark.checkpoint.dir is read from the session's configuration; build_session sets a private
    # folder only when none is configured (local runs).
    yield s
    s.stop()


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="tabulant-test-")


def rows(df, *cols):
    """Rows as sorted tuples (optionally of selected columns)."""
    sel = df.select(*cols) if cols else df
    key = lambda t: tuple((0, 0) if x is None else (1, x) for x in t)
    return sorted((tuple(r) for r in sel.collect()), key=key)
