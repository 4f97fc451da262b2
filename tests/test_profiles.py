"""Stored profiles: exact sums, bounds of the sketches, growth, changed and removed files."""

import os
import random

import pytest
from pyspark.sql import functions as F

from textgauge.operators import profiles, tokenizing


def write(spark, folder, number, texts):
    """One file of documents."""
    rows = [(number * 1000 + i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.coalesce(1).write.mode("append").parquet(str(folder))
    return texts


def made(rng, n):
    common = [f"w{i}" for i in range(20)]
    return [" ".join(rng.choice(common) if rng.random() < 0.6 else f"r{rng.randrange(10**6)}" for _ in range(rng.randint(0, 200))) for _ in range(n)]


def exact(texts, spark):
    df = tokenizing.pretokenize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    sizes = sorted(r.n for r in df.select(F.size("tok").alias("n")).collect())
    counts = {r.t: r["count"] for r in df.select(F.explode("tok").alias("t")).groupBy("t").count().collect()}
    return sizes, counts


def test_profiles_grow_and_shrink(spark, tmp_path):
    rng, folder, store = random.Random(1), tmp_path / "docs", str(tmp_path / "profiles")
    texts = write(spark, folder, 1, [*made(rng, 150), None, ""])
    first = profiles.update_profiles(spark, str(folder), store)
    assert first.count() == 1 and profiles.merge_profiles(first).first().docs == 152
    texts = texts + write(spark, folder, 2, made(rng, 120))
    rows = profiles.update_profiles(spark, str(folder), store)
    again = profiles.update_profiles(spark, str(folder), store)
    assert rows.count() == 2 and again.count() == 2 and spark.read.parquet(store).count() == 2
    got = profiles.merge_profiles(rows, (0.1, 0.5, 0.9), top=5).first()
    sizes, counts = exact(texts, spark)
    assert (got.docs, got.tokens, got.short_docs, got.longest) == (len(sizes), sum(sizes), sum(n < 64 for n in sizes), max(sizes))
    for q, said in zip((0.1, 0.5, 0.9), got.quantiles):
        low, high = (sum(n < said for n in sizes) / len(sizes), sum(n <= said for n in sizes) / len(sizes))
        assert low - 0.02 <= q <= high + 0.02
    best = sorted(counts.values(), reverse=True)[:5]
    assert all(abs(counts[r["item"]] - r["count"]) <= sum(sizes) / (0.75 * profiles.ITEMS) for r in got.frequent)
    assert sorted((counts[r["item"]] for r in got.frequent), reverse=True) == best
    gone = next(f for f in sorted(os.listdir(folder)) if f.endswith(".parquet"))
    os.remove(folder / gone)
    (folder / f".{gone}.crc").unlink(missing_ok=True)
    left = profiles.update_profiles(spark, str(folder), store)
    assert left.count() == 1 and spark.read.parquet(store).count() == 2


def test_no_documents(spark):
    none = spark.createDataFrame([], "file string, tok array<string>")
    row = profiles.merge_profiles(profiles.profile_files(none, by=("file",))).first()
    assert (row.docs, row.tokens, row.mean_length, row.quantiles, row.frequent) == (0, 0, None, None, None)
    empty = spark.createDataFrame([("a", None), ("a", [])], none.schema)
    row = profiles.merge_profiles(profiles.profile_files(empty, by=("file",))).first()
    assert (row.docs, row.tokens, row.short_docs, row.longest, row.frequent) == (2, 0, 2, 0, None)


def test_only_new_files_are_read(spark, tmp_path, monkeypatch):
    folder, store, seen = tmp_path / "docs", str(tmp_path / "profiles"), []

    def tokenize(df):
        seen.append(len(df.inputFiles()))
        return tokenizing.pretokenize(df)

    for number in range(3):
        write(spark, folder, number, ["a b c"])
        profiles.update_profiles(spark, str(folder), store, tokenize)
    assert seen == [1, 1, 1]
    with pytest.raises(Exception):
        profiles.update_profiles(spark, str(tmp_path / "nothing"), store)
