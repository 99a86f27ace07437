from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from defectlake.session import local_session

    session = local_session("8", "tests", memory="8g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return str(DATA)


def rows(df, *cols):
    """Rows as sorted tuples."""
    chosen = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in chosen.collect()), key=str)
