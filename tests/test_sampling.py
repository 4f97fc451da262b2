"""Exact subsamples, splits, ladders and grids."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from textgauge.functions.ordering import order_hash
from textgauge.operators import ladder, sampling, splitting


def digest(seed, salt, *key):
    return hashlib.md5(":".join([str(seed), salt, *map(str, key)]).encode()).hexdigest()


def ids(df, col="id"):
    return {r[col] for r in df.select(col).collect()}


@pytest.mark.parametrize("n", [1, 7, 5000])
@pytest.mark.parametrize("fraction", [0.001, 0.1, 0.29, 0.5, 0.999])
def test_subsample_is_the_hash_prefix(spark, n, fraction):
    got = ids(sampling.subsample(spark.range(n), fraction, ["id"], seed=9))
    k = max(int(n * fraction), 1)
    want = sorted(range(n), key=lambda i: digest(9, "sample", i))[:k]
    assert got == set(want)


def test_full_fraction_is_untouched_and_empty_stays_empty(spark):
    df = spark.range(5)
    assert sampling.subsample(df, 1.0, ["id"]) is df
    assert sampling.subsample(spark.range(0), 0.5, ["id"]).count() == 0


@pytest.mark.parametrize("fraction", [0.0, -0.1, 1.1])
def test_fraction_range(spark, fraction):
    with pytest.raises(ValueError):
        sampling.subsample(spark.range(5), fraction, ["id"])


def test_composite_key(spark):
    df = spark.range(60).select((F.col("id") % 6).alias("doc_id"), F.expr("id div 6").alias("chunk_idx"))
    got = sampling.subsample(df, 0.5, ["doc_id", "chunk_idx"]).collect()
    rows = [(d, c) for d in range(6) for c in range(10)]
    want = sorted(rows, key=lambda r: digest(42, "sample", *r))[:30]
    assert {tuple(r) for r in got} == set(want)


def test_refinement_passes(spark, monkeypatch):
    """Small buckets force several counting passes and give the same cut."""
    monkeypatch.setattr(sampling, "_DIGITS", 1)
    monkeypatch.setattr(sampling, "_SMALL", 2)
    got = ids(sampling.subsample(spark.range(3000), 0.37, ["id"]))
    want = sorted(range(3000), key=lambda i: digest(42, "sample", i))[:1110]
    assert got == set(want)


def test_copies_of_a_key_are_refused_where_they_straddle_the_cut(spark):
    df = spark.range(9000).select(F.lit(1).alias("id"))
    with pytest.raises(ValueError, match="identify"):
        sampling.subsample(df, 0.5, ["id"])


def test_fractions_nest(spark):
    df = spark.range(500)
    small, large = (ids(sampling.subsample(df, f, ["id"])) for f in (0.1, 0.4))
    assert small < large


def test_split_sides_are_disjoint_exhaustive_and_exact(spark):
    df = spark.range(1001)
    for exact in (False, True):
        out = splitting.split(df, ["id"], exact=exact)
        train, test = (ids(out.filter(F.col("split") == s)) for s in ("train", "test"))
        assert not train & test and train | test == set(range(1001))
        if exact:
            assert len(test) == math.ceil(1001 * 0.1)
            assert test == set(sorted(range(1001), key=lambda i: digest(42, "split", i))[:101])


def test_split_unit_doc_keeps_documents_whole(spark):
    df = spark.range(2000).select((F.col("id") % 50).alias("doc_id"), F.col("id").alias("chunk_idx"))
    keys = ["doc_id", "chunk_idx"]
    for exact in (False, True):
        out = splitting.split(df, keys, 0.2, exact=exact)
        sides = out.groupBy("doc_id").agg(F.countDistinct("split").alias("n"))
        assert sides.filter("n > 1").count() == 0
    assert out.filter("split = 'test'").select("doc_id").distinct().count() == 10
    by_chunk = splitting.split(df, keys, 0.2, unit="chunk", exact=True)
    assert by_chunk.filter("split = 'test'").count() == 400


def test_split_arguments(spark):
    with pytest.raises(ValueError):
        splitting.split(spark.range(3), ["id"], unit="row")
    with pytest.raises(ValueError):
        splitting.split(spark.range(3), ["id"], 1.0)


def test_profile_of_nothing(spark):
    empty = spark.createDataFrame([], "split string")
    assert splitting.split_profile(empty).first().asDict() == {
        "train_rows": 0, "train_pct": 0.0, "test_rows": 0, "test_pct": 0.0,
    }


def test_overlap_with_a_hot_document(spark):
    train = spark.createDataFrame([(1,)] * 300 + [(2,)], "doc_id long")
    test = spark.createDataFrame([(1,)] * 50 + [(3,)], "doc_id long")
    got = splitting.split_overlap(train, test, ["doc_id"]).first()
    assert tuple(got) == (1, 1, 1)
    assert splitting.leaked_rows(train, test, ["doc_id"]).count() == 50


def test_grid_order_and_size(spark):
    runs = ladder.run_grid(spark).orderBy("run_idx").collect()
    want = [(m, f, s) for m in ladder.MODELS for f in ladder.FRACTIONS for s in ladder.SEEDS]
    assert [tuple(r)[1:] for r in runs] == want and len(runs) == 54


@pytest.mark.parametrize(
    "tier, world, effective",
    [("low_vram", 1, 32), ("low_vram", 16, 64), ("high_throughput", 1, 32), ("default", 3, 24)],
)
def test_effective_batch(spark, tier, world, effective):
    one = spark.createDataFrame([(65,)], "chunks long")
    row = ladder.run_budget(one, 10, world=world, epochs=2).filter(F.col("tier") == tier).first()
    assert row["effective_batch"] == effective
    assert row["steps"] == math.ceil(65 / effective) * 2 and row["train_tokens"] == 1300


def test_ladder_against_separate_subsamples(spark):
    df = spark.range(777).withColumn("tokens", F.col("id") % 13)
    got = {
        (r["seed"], r["fraction"]): (r["docs"], r["tokens"])
        for r in ladder.fraction_ladder(df, (0.001, 0.3, 1.0), (1, 2), ["id"], ["tokens"]).collect()
    }
    for seed in (1, 2):
        for f in (0.001, 0.3, 1.0):
            part = sampling.subsample(df, f, ["id"], seed)
            want = part.agg(F.count("*"), F.sum("tokens")).first()
            assert got[seed, f] == tuple(want)


def test_composite_keys_do_not_collide(spark):
    rows = [(None, "c"), ("c", None), ("a:b", "c"), ("a", "b:c"), ("\\N", "c"), ("", "c"), ("a\\", ":c")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert df.select(order_hash(42, "sample", ["a", "b"]).alias("h")).distinct().count() == len(rows)
    assert sampling.subsample(df, 1.0, ["a", "b"]).count() == len(rows)
    numbers = spark.createDataFrame([(5, 17)], "a int, b long").select(order_hash(42, "sample", ["a", "b"])).first()[0]
    assert numbers == hashlib.md5(b"42:sample:5:17").hexdigest()
