"""Every registered query against its oracle statement on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare, oracle_connection

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF_DIR)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    if name in entry.oracle_sql():
        same, note = compare(df, con, entry.oracle_sql()[name])
        assert same, note
    else:
        assert df.count() > 0


def test_statements_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    hits = entry.entry(spark)
    assert hits.columns == ["request_id", "order", "id", "title", "abstract", "article_type", "topics", "score"]
    assert hits.count() > 0
