"""Every registered query against its SQL on the smallest data."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    assert compare(spark, con, SF, entry.queries()[name], entry.oracle_sql().get(name)) is None


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 1 and 0 <= rows[0]["ndcg"] <= rows[0]["hit_rate"] <= 1


def test_registry_needs_no_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=".", timeout=60).returncode == 0
