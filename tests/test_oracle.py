"""Every registered query against its SQL, on the small tables."""

import pytest
from compare import compare, duck

from __spark_entry__ import entry
from textgauge.catalog import QUERIES, SQL


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql(spark, con, small, name):
    assert compare(spark, con, name, QUERIES[name], SQL[name], small) == ""


def test_entry(spark):
    rows = entry(spark).orderBy("fraction").collect()
    assert [r["fraction"] for r in rows] == [0.0, 0.1, 0.5, 1.0]
    losses = [r["eval_loss"] for r in rows]
    assert losses == sorted(losses, reverse=True)
    assert rows[0]["perplexity"] == 256.0
