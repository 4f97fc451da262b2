"""Registered queries that SQL can express, against their SQL."""

import pytest
from compare import compare, duck

from textgauge.llm.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


@pytest.mark.parametrize("name", [n for n in SQL if n != "op2_fingerprint"])
def test_matches_sql(spark, con, small, name):
    assert compare(spark, con, name, QUERIES[name], SQL[name], small) == ""
