"""Near-duplicate groups against comparing all pairs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from textgauge.llm import near
from textgauge.llm.components import components
from textgauge.llm.queries import QUERIES
from textgauge.llm.shingles import shingle_sets, superminhash


def shingles(text, k):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def groups(rows, k, threshold=80):
    """(id, size, least id of the group) by comparing all pairs that share a shingle."""
    sets = [shingles(t, k) for _, t in rows]
    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, s in enumerate(sets):
        common = {}
        for x in s:
            for b in by[x]:
                if b > a:
                    common[b] = common.get(b, 0) + 1
        for b, n in common.items():
            if 100 * n >= threshold * (len(s) + len(sets[b]) - n):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, (key, _) in enumerate(rows):
        r = root(i)
        least[r] = min((v for v in (least.get(r), key) if v is not None), default=None)
    return sorted(((key, len(sets[i]), least[root(i)]) for i, (key, _) in enumerate(rows)), key=str)


def near_copies(seed, base, n, edits):
    rng = random.Random(seed)
    words = [f"w{rng.randrange(3000)}" for _ in range(base)]
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(base)] = f"x{rng.randrange(9000)}"
        out.append(" ".join(w))
    return out


EDGES = [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "a b c"), (906, "a b c"), (None, "a b  C"), (None, None),
         (905, "a b c"), (907, "a b c d"), (908, "x y z"), (909, "É é"), (910, "é é")]


@pytest.mark.parametrize("k,block", [(4, 512), (5, 20)])
def test_groups(spark, monkeypatch, k, block):
    monkeypatch.setattr(near, "BLOCK", block)
    texts = near_copies(1, 150, 120, 9) + near_copies(2, 60, 60, 4) + near_copies(3, 20, 30, 2)
    rows = list(enumerate(texts)) + EDGES
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    _, placed, _ = near.near_groups(docs, k=k)
    got = sorted(((r.id, r.n, r.component) for r in placed.collect()), key=str)
    want = groups(rows, k)
    assert got == want
    assert len({g[2] for g in want}) > 30  # the fixture holds pairs on both sides of the threshold


def test_dedup_keeps_rows_whole(spark):
    rows = [(i, t, i, None) for i, t in enumerate(near_copies(1, 150, 12, 2))] + [(a, b, 1, "z") for a, b in EDGES]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rid long, Sig string")
    kept = near.near_dedup(docs)
    assert kept.columns == docs.columns
    out = [tuple(r) for r in kept.collect()]
    ids = sorted((r[0] for r in out), key=str)
    assert set(out) <= set(rows) and ids == sorted([0, 900, 901, 902, 903, None, 905, 907, 908, 909, 910], key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near.near_dedup(docs).count() == 0


def test_components_over_many_tasks(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(300) if i % 100 != 99] + [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(80)]
    rng.shuffle(links)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = dict(components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    parent = {x: x for e in links for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: root(x) for x in parent}


def test_estimates():
    rng = np.random.default_rng(0)
    for n, shared in ((5, 4), (40, 36), (700, 620)):
        seen = []
        for _ in range(150):
            pool = rng.integers(0, 2**63, 2 * n - shared).astype(np.uint64)
            s = superminhash([np.sort(pool[:n]), np.sort(pool[n - shared :])], 128)
            seen.append((s[0] == s[1]).mean())
        j = shared / (2 * n - shared)
        assert abs(np.mean(seen) - j) < 0.01 and np.std(seen) < (j * (1 - j) / 128) ** 0.5


def test_long_text_in_slices(monkeypatch):
    text = "One two  three\tfour five six " * 300 + "x" * 500
    whole = shingle_sets([text, "a b"], 5)
    monkeypatch.setattr("textgauge.llm.shingles.SLICE", 40)
    for a, b in zip(shingle_sets([text, "a b"], 5), whole):
        assert (a == b).all()


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = QUERIES["op6_near_dedup"](spark, folder)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == groups(rows, 4)
    assert got.filter("kept <> (doc_id = component_id)").count() == 0
