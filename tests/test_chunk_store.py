"""Bucketed chunk tables: results as on plain tables, and no chunk is shuffled."""

import uuid

import pytest
from pyspark.sql import functions as F

from textgauge.operators import chunking, splitting
from textgauge.sources import chunk_store


@pytest.fixture
def names():
    return f"t{uuid.uuid4().hex}", f"t{uuid.uuid4().hex}"


def made(spark, folder, names, chunks, docs, buckets=4):
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = chunk_store.write_bucketed(chunks, names[0], f"{folder}/chunks", buckets)
        b = chunk_store.write_bucketed(docs, names[1], f"{folder}/docs", buckets, sort=("doc_id",))
        found = chunk_store.verify_stored(a, b, 4, 3)
        return tuple(found.first()), found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)


def test_sound_and_broken_tables(spark, tmp_path, names):
    docs = spark.createDataFrame([(i, list(range(i, i + 3 * i))) for i in range(12)] + [(50, [])], "doc_id long, input_ids array<int>")
    chunks = chunking.chunk(docs, 4, 3)
    got, said = made(spark, tmp_path / "a", names, chunks, docs)
    assert got == tuple(chunking.verify_chunks(chunks, docs, 4, 3).first())
    assert "hashpartitioning" not in said and said.count("Bucketed: true") >= 2
    key = F.struct("doc_id", "chunk_idx")
    broken = chunks.filter(key != F.struct(F.lit(5).cast("long"), F.lit(1)))
    broken = broken.unionByName(chunks.filter("doc_id = 6 AND chunk_idx < 2"))  # repeated
    changed = F.when(key == F.struct(F.lit(8).cast("long"), F.lit(2)), F.array(*map(F.lit, (1, 2, 3, 4))))
    short = F.when(key == F.struct(F.lit(9).cast("long"), F.lit(0)), F.array(F.lit(9)))
    broken = broken.withColumn("input_ids", F.coalesce(changed, short, "input_ids"))
    more = spark.createDataFrame([(77, 0, 0, [1, 2, 3, 4]), (7, 90, 270, [1, 2, 3, 4])], chunks.select("doc_id", "chunk_idx", "start", "input_ids").schema)
    broken = broken.select(more.columns).unionByName(more)
    got, _ = made(spark, tmp_path / "b", [n + "b" for n in names], broken, docs)
    want = tuple(chunking.verify_chunks(broken.dropDuplicates(["doc_id", "chunk_idx"]), docs, 4, 3).first())
    assert got[0] == want[0] + 2 and got[2:4] == (want[2], want[3] + 2) and got[4] == want[4]
    assert got[1] == want[1] and got[5] == want[5]


def test_overlap_and_a_second_declaration(spark, tmp_path, names):
    rows = spark.createDataFrame([(i % 7, i, "test" if i % 5 == 0 else "train") for i in range(40)] + [(90, 1, "test")], "doc_id long, chunk_idx int, split string")
    stored = chunk_store.write_bucketed(rows, names[0], f"{tmp_path}/it's here", 3)
    again = chunk_store.declare_bucketed(spark, names[1], f"{tmp_path}/it's here", 3)
    want = splitting.split_overlap(rows.filter("split = 'train'"), rows.filter("split = 'test'"), ["doc_id"]).first()
    for table in (stored, again):
        found = chunk_store.stored_overlap(table)
        assert found.first() == want
        assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()


def test_buckets_grow_with_the_table(spark):
    sizes = spark.createDataFrame([(1, 500), (2, None), (3, 1501)], "doc_id long, n int")
    counts = [chunk_store.bucket_count(sizes, F.col("n"), 3, tokens) for tokens in (10, 500, 1000)]
    assert counts == [201, 5, 3] and chunk_store.bucket_count(sizes.limit(0), F.col("n")) == 8
    many = spark.range(40).select(F.lit(2**31 - 1).alias("n"))
    assert chunk_store.bucket_count(many, F.col("n")) == -(-40 * (2**31 - 1) // chunk_store.BUCKET_TOKENS)
