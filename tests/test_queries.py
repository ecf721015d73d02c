"""Every registered query with a check equals DuckDB at the smallest scale."""

import pytest
from compare import compare, duck

from workloom.plans import all_checks, all_queries

FOLDER = "/root/testdata/sf0.001"
CHECKS = all_checks()
QUERIES = all_queries()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_equals_check(spark, con, name):
    assert compare(QUERIES[name](spark, FOLDER), con, CHECKS[name]) == ""


@pytest.mark.parametrize("name", ["dd3_fuzzy", "dd5_removal_counts"])
def test_rows_only(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
