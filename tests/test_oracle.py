"""Every registered query against its oracle SQL on the smallest given tables."""

import os

import pytest

import __spark_entry__ as entry_points
from tests.oracle import compare, duck

SF_DIR = os.environ.get("PAGEFLOW_TEST_SF", "/root/testdata/sf0.001")
QUERIES = entry_points.queries()
ORACLES = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(q for q in QUERIES if not q.startswith("op") and q != "pipeline"))
def test_query_equals_oracle(spark, con, name):
    problem, rows = compare(spark, con, QUERIES[name], ORACLES.get(name), SF_DIR)
    assert problem is None, problem
    assert rows >= 0


def test_every_query_of_the_library_has_an_oracle():
    optional = {q for q in QUERIES if q.startswith("op") or q == "pipeline"}
    assert set(QUERIES) - set(ORACLES) <= optional


def test_entry_is_lazy_and_has_rows(spark):
    df = entry_points.entry(spark)
    assert df.columns[:4] == ["job_id", "filename", "page", "angle"]
    assert df.limit(1).count() == 1
