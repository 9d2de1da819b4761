"""Queries with an SQL twin, whole result against whole result."""

import os

import pytest
from harness import compare, connect

from plotlink.llm.catalog import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("slug", sorted(SQL))
def test_equals_sql(spark, slug):
    diff, _ = compare(QUERIES[slug](spark, SF), connect(SF), SQL[slug])
    assert diff is None, diff
