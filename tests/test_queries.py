"""Every registered query against its DuckDB text on the smallest tables."""

import os

import pytest

from compare import compare, connect
from gleaner.plans.registry import oracle_sql, queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = queries(), oracle_sql()
# whole runs are covered by test_runs.py; TEST_QUERIES=all adds them here
NAMES = [n for n in QUERIES if not n.startswith("run_") or os.environ.get("TEST_QUERIES") == "all"]


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    note, ok = compare(spark, duck, name, QUERIES[name], SQL.get(name), FOLDER)
    assert ok, note


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
