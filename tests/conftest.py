from __future__ import annotations

import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from eventloom.session import local_session

    session = local_session(4, "eventloom-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return SMALL
