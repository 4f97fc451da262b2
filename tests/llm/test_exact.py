"""Exact dedup against a plain grouping of texts, also with identifiers that clash."""

import re

import pytest
from pyspark.sql import functions as F

from textgauge.llm.exact import exact_dedup, exact_groups

SCHEMA = "doc_id long, text string, rid string, Recipe int, _words string"
LONG = " ".join(f"word{i * i % 977}" for i in range(5000))
ROWS = [
    (3, "a  b\tc", "x", 1, None),
    (1, "a b c", None, 2, "w"),
    (2, None, "y", None, None),
    (5, "", "y", None, None),
    (4, " ", "z", 3, None),
    (None, "\n", "n", 4, None),
    (None, LONG, "n", 4, None),
    (7, LONG + " end", "n", 4, None),
    (8, LONG, "n", 4, None),
    (8, LONG, "n", 4, None),
    (9, "a b c d", "n", 4, None),
    (10, "a b c", "n", 4, None),
    (11, "a b c ", "n", 4, None),
]


def groups(rows):
    by = {}
    for i, r in enumerate(rows):
        by.setdefault(re.sub("[ \t-\r]+", " ", r[1] or ""), []).append(i)
    return by


@pytest.mark.parametrize("identify", [F.xxhash64, lambda c: F.pmod(F.xxhash64(c), F.lit(3))])
def test_groups(spark, identify):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    _, placed, _ = exact_groups(docs, identify=identify, mean_words=16)
    got = sorted(((r.id, r.keep_id, r.group_size) for r in placed.collect()), key=str)
    want = []
    for members in groups(ROWS).values():
        ids = [ROWS[i][0] for i in members]
        keep = min((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids)) for i in ids]
    assert got == sorted(want, key=str)
    assert placed.filter("kept").count() == len(groups(ROWS))


def test_dedup_keeps_rows_whole(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    kept = exact_dedup(docs)
    assert kept.columns == docs.columns
    rows = [tuple(r) for r in kept.collect()]
    assert len(rows) == len(groups(ROWS)) and set(rows) <= set(ROWS)
    assert {r[0] for r in rows} == {1, 2, 4, 7, 8, 9, 10, 11}


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact_dedup(docs).count() == 0
    assert exact_groups(docs)[1].count() == 0


def test_plan_is_native(spark, plan):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    assert "Python" not in plan(exact_groups(docs)[1])
