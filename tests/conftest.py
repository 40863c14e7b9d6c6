from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from docflow.session import build_session

    s = build_session("docflow-tests", cpus="*", shuffle_partitions=8)
    yield s
    s.stop()


def rows(df, *cols):
    """Collect as sorted tuples of the given columns (all columns when none given)."""
    cols = cols or tuple(df.columns)
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
