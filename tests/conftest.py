import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from plantlens.session import local_session

    session = local_session(8, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    """Short blocks, so that small fixtures cross many block borders."""
    from plantlens.operators import blocks

    monkeypatch.setattr(blocks, "BLOCK_ROWS", 8)
