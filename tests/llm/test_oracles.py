"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

from corpusloom.llm.queries import ORACLES, QUERIES
from tests.compare import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_gives_every_row(spark, name):
    assert QUERIES[name](spark, SF).count() >= spark.read.parquet(f"{SF}/documents.parquet").count()
