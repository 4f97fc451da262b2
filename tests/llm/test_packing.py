"""Packing against a plain best fit over lists, and the conditions that every packing must meet."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from textgauge.llm import packing
from textgauge.llm.queries import QUERIES


def plain(sizes, sources, clusters, capacity):
    """Bins as sets of (item, piece)."""
    bins, rest = [], []
    for i, s in enumerate(sizes):
        full = max(0, (s - 1) // capacity)
        bins += [(0, {(i, p)}, set()) for p in range(full)]
        rest.append((s - full * capacity, full))
    fixed, open_ = bins, []
    for i in sorted(range(len(sizes)), key=lambda i: -rest[i][0]):
        size, piece = rest[i]
        marks = {("s", sources[i]), ("c", clusters[i])} - {("s", None), ("c", None)}
        fits = [b for b in open_ if b[0] >= size and not (b[2] & marks)]
        if fits:
            best = min(fits, key=lambda b: b[0])
            open_.remove(best)
        else:
            best = (capacity, set(), set())
        open_.append((best[0] - size, best[1] | {(i, piece)}, best[2] | marks))
    return [b[1] for b in fixed + open_]


def made_bins(rows):
    by = defaultdict(set)
    for item, piece, _, bin_, _ in rows:
        by[bin_].add((item, piece))
    return by


@pytest.mark.parametrize("seed", range(6))
def test_same_room_as_plain_best_fit(seed):
    rng = random.Random(seed)
    n, capacity = 300, 100
    sizes = [rng.choice([0, 1, 30, 50, 100, 101, 350]) if rng.random() < 0.2 else rng.randrange(1, 120) for _ in range(n)]
    sources = [rng.choice([None, *range(seed * 20 + 2)]) for _ in range(n)]
    clusters = [rng.choice([None, rng.randrange(200)]) for _ in range(n)]
    rows = packing.pack_block(np.array(sizes), sources, clusters, capacity)
    left = lambda bins: sorted(capacity - sum(min(capacity, sizes[i] - p * capacity) for i, p in b) for b in bins)
    assert left(made_bins(rows).values()) == left(plain(sizes, sources, clusters, capacity))


def test_tightest_compatible_bin():
    # the bin of 90 is tightest for 10 but holds the same source, that of 80 the same cluster
    rows = packing.pack_block(np.array([90, 80, 70, 10]), ["a", "b", "c", "a"], [1, 2, 3, 2], 100)
    assert sorted(map(sorted, made_bins(rows).values())) == [[(0, 0)], [(1, 0)], [(2, 0), (3, 0)]]


def conditions(rows, sizes, capacity):
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r.bin].append(r)
        pieces[r.doc_id].append(r)
    for b in bins.values():
        assert sum(r.length for r in b) <= capacity
        assert sorted(r.place for r in b) == list(range(len(b)))
    for key, parts in pieces.items():
        parts.sort(key=lambda r: r.piece)
        assert [r.start for r in parts] == [i * capacity for i in range(len(parts))] and sum(r.length for r in parts) == sizes[key]
    assert set(pieces) == set(sizes)
    return bins


def test_job(spark, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS", 50)
    rows = [(i, f"s{i % 3}" if i % 7 else None, (i * 37) % 90 + (900 if i == 5 else 0), "c" if i % 11 == 0 else None, 1) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long, cluster string, bin int").repartition(3)
    got = packing.pack(docs, F.col("size"), F.col("cluster"), 100).collect()
    bins = conditions(got, {r[0]: r[2] for r in rows}, 100)
    by = {r[0]: r for r in rows}
    for b in bins.values():
        for col in (1, 3):
            held = [by[r.doc_id][col] for r in b if by[r.doc_id][col] is not None]
            assert len(held) == len(set(held))
    assert sum(r.doc_id == 5 for r in got) == 10


def test_edges(spark):
    schema = "doc_id long, source string, size long, cluster string"
    docs = spark.createDataFrame([(None, None, None, None), (1, "a", 3, "x"), (1, "a", 3, "x")], schema)
    got = packing.pack(docs, F.col("size"), F.col("cluster"), 10).collect()
    assert sorted((str(r.doc_id), r.length) for r in got) == [("1", 3), ("1", 3), ("None", 0)]
    assert len({r.bin for r in got if r.doc_id == 1}) == 2
    assert packing.pack(docs.limit(0), F.col("size"), F.col("cluster"), 10).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    sizes = {d.doc_id: len((d.text or "").encode()) + 1 for d in docs}
    source = {d.doc_id: d.source for d in docs}
    text = {d.doc_id: " ".join((d.text or "").lower().split()) for d in docs}
    bins = conditions(QUERIES["op7_packing"](spark, folder).collect(), sizes, 8192)
    for b in bins.values():
        assert len({source[r.doc_id] for r in b}) == len(b) == len({text[r.doc_id] for r in b})
    assert sum(sizes.values()) / (8192 * len(bins)) > 0.9
