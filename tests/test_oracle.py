"""Every registered query with an SQL twin, whole result against whole result."""

import os

import pytest
from harness import compare, connect

from plotlink.catalog.all import QUERIES, SQL, oracle_text

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ROWS_ONLY = sorted(set(QUERIES) - set(SQL))


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("slug", sorted(SQL))
def test_equals_sql(spark, con, slug):
    diff, _ = compare(QUERIES[slug](spark, SF), con, oracle_text(slug))
    assert diff is None, diff


@pytest.mark.parametrize("slug", ROWS_ONLY)
def test_runs(spark, slug):
    assert QUERIES[slug](spark, SF).count() >= 0
