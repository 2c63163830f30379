import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

import pytest

import checking


@pytest.fixture(scope="session")
def spark():
    import __spark_entry__ as contract

    session = checking.session()
    contract.ship(session)
    yield session
    session.stop()


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "tables")
