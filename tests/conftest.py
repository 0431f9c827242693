from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from tessera.session import build_session

    session = build_session("tests", cpus=4, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Collects a frame as a sorted list of tuples of the named columns."""

    def collect(df, *columns):
        columns = columns or df.columns
        return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)

    return collect
