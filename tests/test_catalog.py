"""Every query with SQL gives the rows DuckDB gives."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry
import check

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
CHECKED = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", CHECKED)
def test_same_rows(spark, con, name):
    note, _, _ = check.compare(spark, con, name, SF)
    assert note.startswith("same"), note


def test_every_query_returns_its_columns(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
