"""Fingerprints: edge cases, the ring of successors, merging, accuracy of containment, SQL on the table."""

import hashlib
import random
import re

import pytest
from compare import compare, duck
from pyspark.sql import functions as F

from textgauge.llm import fingerprint as fp
from textgauge.llm.queries import QUERIES, SQL


def plain(text, k=5, limit="40000000"):
    joined = re.sub("[ \t-\r]+", " ", text or "").strip(" ")
    words = joined.split(" ") if joined else []
    grams = {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()
    hashes = [hashlib.md5(g.encode()).hexdigest() for g in grams]
    return max(0, len(words) - k) + 1 if words else 0, joined, sorted({h[:12] for h in hashes if h < limit})


def alike(a, b):
    if a[1] == b[1]:
        return 1.0
    small = min(len(a[2]), len(b[2]))
    return len(set(a[2]) & set(b[2])) / small if small else 0.0


def test_against_plain_python(spark):
    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice(["élan", "a", "bb", "c\n", "日本"]) + str(rng.randrange(90)) for _ in range(n))
    texts = [None, "", " ", "one", "a b c d e", "x" * 5000, say(3000), say(40), say(41), "a b c d e"] + [say(rng.randrange(1, 80)) for _ in range(30)]
    rows = [(3 * i, t, "x", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, cut int").repartition(4)
    got = {r.doc_id: r for r in fp.edited_fingerprints(docs).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(texts):
        after = texts[(i + 1) % len(texts)] or ""
        t = t or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        r, own, other, next_ = got[3 * i], plain(t), plain(edited), plain(after)
        assert (r.n_chars, r.edited) == (len(t), edited)
        assert (r.sketch.n, r.sketch.hashes) == (own[0], own[2])
        assert (r.edited_sketch.n, r.edited_sketch.hashes) == (other[0], other[2])
        assert (r.near_edited, r.near_next) == (alike(own, other), alike(own, next_))


def test_repeated_and_missing_keys(spark):
    rows = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (1, "long text of other words here"), (None, "abcd efgh"), (None, None), (5, "12345678")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_chars, r.edited, r.near_next) for r in fp.edited_fingerprints(docs).collect()), key=str)
    assert len(got) == len(rows)
    assert got[:2] == [(1, 15, "a b c d e f 123", 0.0)] * 2
    assert [g[1:] for g in got if g[0] is None] == [(0, "", 0.0), (9, "abcd ef", 0.0)]
    single = spark.createDataFrame([(9, "abcd" * 3)], docs.schema)
    assert [(r.edited, r.near_edited, r.near_next) for r in fp.edited_fingerprints(single).collect()] == [("abcdabcdaabc", 0.0, 1.0)]
    assert fp.edited_fingerprints(docs.limit(0)).count() == 0


def test_merge_is_the_sketch_of_the_union(spark):
    rows = [("a", "p q r s t u v w x y"), ("a", "p q r s t z1 z2 z3 z4"), ("b", None), ("b", "k")]
    docs = spark.createDataFrame(rows, "g string, text string").withColumn("text", F.coalesce("text", F.lit("")))
    got = {r.g: r.hashes for r in fp.merged(fp.sketched(docs, "text", "s", share=1.0), ["g"], "s").collect()}
    for g in "ab":
        assert got[g] == sorted({h for x, t in rows if x == g for h in plain(t, limit="g")[2]})


def test_containment_of_unequal_texts(spark):
    rng = random.Random(9)
    words = [f"w{rng.randrange(10**6)}" for _ in range(20_000)]
    docs = spark.createDataFrame([(" ".join(words), " ".join(words[500:1500] + [f"q{i}" for i in range(1000)]))], "a string, b string")
    made = fp.sketched(fp.sketched(docs, "a", "sa"), "b", "sb").select(fp.likeness("sa", "sb").alias("x")).first()
    assert made.x == pytest.approx(0.5, abs=0.08)


def test_query(spark, small, plan):
    assert compare(spark, duck(small), "op2", QUERIES["op2_fingerprint"], SQL["op2_fingerprint"], small) == ""
    assert not any(x in plan(QUERIES["op2_fingerprint"](spark, small)) for x in ("Python", "Pandas", "Arrow"))
