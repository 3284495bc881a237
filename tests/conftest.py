"""One local session for all tests; tables come from the given test data or are made in place."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import get_session, reachable

    s = get_session("tests", 4, spark__sql__shuffle__partitions="4")
    reachable(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def base():
    return SF
