"""Every named query against its SQL on the given tables."""

import os

import pytest

import __spark_entry__ as entry_points
from catalens.bindings.registry import ORACLE, QUERIES
from compare import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ROWS_ONLY = {"j7_face_match_lsh", "a7_train_people", "a7_train_kernel", "a8_predict_people"}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_only_known_queries_lack_sql():
    assert set(QUERIES) - set(ORACLE) == ROWS_ONLY
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, name):
    rows, problems = compare(QUERIES[name](spark, SF_DIR), con, ORACLE[name])
    assert not problems, problems
    assert rows or SF_DIR.endswith("0.001")


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() >= 0


def test_entry(spark):
    result = entry_points.entry(spark)
    assert result.columns == ["type", "requests", "hits", "misses"]
    assert result.count() == 5
