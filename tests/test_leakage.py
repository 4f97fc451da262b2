"""Overlapping windows across a split against a walk over positions, and the plan."""

import random

import pytest

from textgauge.operators import leakage


def plain(train, test, m):
    out = {}
    for side, own, other in (("train", train, test), ("test", test, train)):
        held = {(d, p) for d, a in other if d is not None and a is not None for p in range(a, a + m)}
        for d, a in set(own):
            pairs = sum(e == d and b is not None and a is not None and abs(a - b) < m for e, b in other) if d is not None else 0
            if pairs:
                out[side, d, a] = (own.count((d, a)), pairs, sum((d, p) in held for p in range(a, a + m)))
    return out


@pytest.mark.parametrize("m,stride", [(8, 3), (8, 8), (5, 1), (4, 9), (1, 1)])
def test_against_positions(spark, m, stride):
    rng = random.Random(m * 10 + stride)
    sides = ([], [])
    for doc in range(5):
        for i in range(rng.randint(0, 12)):
            sides[rng.random() < 0.3].append((doc, i * stride))
    sides[0].extend([(None, 0), (1, None), (0, 0), (0, 0)])
    sides[1].extend([(None, 0), (1, None), (0, stride)])
    train, test = (spark.createDataFrame(s, "doc_id long, start long") for s in sides)
    got = leakage.window_overlaps(train, test, m).collect()
    want = plain(*sides, m)
    assert {(r.side, r.doc_id, r.start): (r.copies, r.pairs, r.shared_tokens) for r in got} == want
    total = {r.side: r for r in leakage.window_leakage(train, test, m).collect()}
    for i, side in enumerate(("train", "test")):
        own = [v for k, v in want.items() if k[0] == side]
        sums = (len(sides[i]), sum(c for c, _, _ in own), sum(c * p for c, p, _ in own), sum(c * t for c, _, t in own))
        assert tuple(total[side])[1:] == sums
    assert total["train"].pairs == total["test"].pairs


def test_empty_sides(spark):
    none = spark.createDataFrame([], "doc_id long, start long")
    some = spark.createDataFrame([(1, 0)], none.schema)
    assert {tuple(r) for r in leakage.window_leakage(some, none, 4).collect()} == {("train", 1, 0, 0, 0), ("test", 0, 0, 0, 0)}
    with pytest.raises(ValueError):
        leakage.window_leakage(some, none, 0)


def test_no_cross_join(spark, plan):
    rows = spark.createDataFrame([(1, 0)], "doc_id long, start long")
    said = plan(leakage.window_overlaps(rows, rows, 4))
    assert "Cartesian" not in said and "NestedLoop" not in said
