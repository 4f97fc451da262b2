"""Windows, accounting, verification, preparation and the stream."""

import random

import pytest
from pyspark.sql import functions as F

from textgauge.functions import windows
from textgauge.operators import chunking
from textgauge.plans.prepare import prepare
from textgauge.sources import chunks as files
from textgauge.streaming import chunk_stream as streams

SHAPES = [(4, 4), (4, 1), (4, 3), (4, 7), (1, 1)]


def lengths(m, s):
    random.seed(m * 100 + s)
    return [0, m - 1, m, m + s - 1, m + s] + [random.randrange(60) for _ in range(30)]


def docs_of(spark, sizes):
    rows = [(i, [i * 1000 + j for j in range(n)]) for i, n in enumerate(sizes)]
    return spark.createDataFrame(rows, "doc_id long, input_ids array<int>")


def brute(n, m, s):
    return [list(range(a, a + m)) for a in range(0, n - m + 1, s)]


@pytest.mark.parametrize("m, s", SHAPES)
def test_chunks_equal_brute_force(spark, m, s):
    sizes = lengths(m, s)
    got = {
        (r["doc_id"], r["chunk_idx"]): (r["start"], r["input_ids"])
        for r in chunking.chunk(docs_of(spark, sizes), m, s).collect()
    }
    want = {
        (d, i): (w[0], [d * 1000 + p for p in w])
        for d, n in enumerate(sizes)
        for i, w in enumerate(brute(n, m, s))
    }
    assert got == want


@pytest.mark.parametrize("m, s", SHAPES)
def test_accounting_equals_brute_force(spark, m, s):
    sizes = lengths(m, s)
    df = docs_of(spark, sizes)
    n = F.size("input_ids")
    all_windows = [brute(n, m, s) for n in sizes]
    covered = [{p for w in ws for p in w} for ws in all_windows]
    stats = chunking.chunk_stats(df, n, m, s).first().asDict()
    assert stats == {
        "docs": len(sizes),
        "short_docs": sum(x < m for x in sizes),
        "chunks": sum(map(len, all_windows)),
        "tokens": sum(sizes),
        "chunk_tokens": sum(map(len, all_windows)) * m,
        "covered_tokens": sum(map(len, covered)),
        "dropped_tokens": sum(sizes) - sum(map(len, covered)),
    }
    want = {}
    for size, ws in zip(sizes, all_windows):
        for p in range(size):
            k = sum(p in w for w in ws)
            want[k] = want.get(k, 0) + 1
    got = chunking.chunk_coverage(df, n, m, s).collect()
    assert {r["windows"]: r["positions"] for r in got} == want


def test_default_stride_gives_back_the_prefix(spark):
    df = docs_of(spark, [23])
    chunks = chunking.chunk(df, 5).orderBy("chunk_idx").collect()
    assert [t for c in chunks for t in c["input_ids"]] == list(range(20))


@pytest.mark.parametrize("m, s", [(0, 1), (4, 0), (4, -1)])
def test_window_arguments(m, s):
    with pytest.raises(ValueError):
        windows.check_window(m, s)


def test_verification_finds_each_fault(spark):
    docs = docs_of(spark, [30, 12])
    good = chunking.chunk(docs, 8, 5)
    assert tuple(chunking.verify_chunks(good, docs, 8, 5).first()) == (6, 4, 0, 0, 0, 0)

    def check(chunks):
        return chunking.verify_chunks(chunks, docs, 8, 5).first().asDict()

    lost = check(good.filter("NOT (doc_id = 0 AND chunk_idx = 1)"))
    assert lost["missing_or_extra"] == 1 and lost["chunks"] == 5
    twice = check(good.unionByName(good.filter("doc_id = 1")))
    assert twice["missing_or_extra"] == 1
    cut = check(good.withColumn("input_ids", F.expr("if(chunk_idx = 2, slice(input_ids, 1, 7), input_ids)")))
    assert cut["wrong_length"] == 1 and cut["not_source_text"] == 1
    other = check(
        good.withColumn("input_ids", F.expr("if(chunk_idx = 2, transform(input_ids, x -> x + 1), input_ids)"))
    )
    assert other["not_source_text"] == 1 and other["overlap_differs"] == 2


@pytest.mark.parametrize(
    "fraction, label", [(None, "full"), (1.0, "full"), (0.10, "10pct"), (0.29, "28pct"), (0.5, "50pct")]
)
def test_fraction_label(fraction, label):
    assert files.fraction_label(fraction) == label


def test_saved_chunks(spark, tmp_path):
    docs = spark.createDataFrame([(0, "x" * 21), (1, "short"), (2, "é" * 10)], "doc_id long, text string")
    made = prepare(docs, max_length=8, stride=4, save_to=str(tmp_path))
    assert made.path.endswith("bytes_m8_s4_full") and made.rows == 8
    assert made.stats.first()["chunks"] == 8 and made.stats.first()["short_docs"] == 1
    back = files.read_chunks(spark, made.path)
    assert back.filter("labels != input_ids OR size(input_ids) != 8").count() == 0
    assert files.stored_bytes(spark, made.path) > 0
    with pytest.raises(Exception, match="(?i)exist"):
        prepare(docs, max_length=8, stride=4, save_to=str(tmp_path))
    masked = back.withColumn("labels", F.transform("input_ids", lambda x: F.lit(-100)))
    path, rows = files.write_chunks(
        masked, str(tmp_path), fraction=0.5, tokenizer="masked", max_length=8, stride=4
    )
    assert path.endswith("masked_m8_s4_50pct_f0.5") and rows == 8
    assert files.read_chunks(spark, path).filter("labels[0] = -100").count() == 8
    # another stride has another name
    assert prepare(docs, max_length=8, save_to=str(tmp_path)).rows == 4


def test_stream_equals_batch_and_goes_on_after_a_restart(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def add(first):
        rows = [(first + i, "ab" * (20 + i)) for i in range(10)]
        spark.createDataFrame(rows, "doc_id long, text string").write.mode("append").parquet(source)

    def drain():
        docs = streams.read_corpus_stream(spark, source, max_files=1)
        streams.start_append(streams.chunk_stream(docs, 16, 8), out, state).awaitTermination()

    add(0)
    drain()
    add(100)
    drain()
    stream = files.read_chunks(spark, out)
    from textgauge.operators.tokenizing import byte_tokenize

    batch = chunking.with_labels(chunking.chunk(byte_tokenize(spark.read.parquet(source)), 16, 8))
    assert stream.count() == batch.count() > 0
    assert stream.exceptAll(batch.select(stream.columns)).count() == 0


@pytest.mark.parametrize("m,s", [(4, 1), (4, 2), (5, 3), (4, 4), (3, 7), (1, 1)])
def test_coverage_of_any_length(spark, m, s):
    lengths = [*range(0, 40), 200]
    df = spark.createDataFrame([(n,) for n in lengths], "n int")
    got = {(r["n"], r["windows"]): r["positions"] for r in chunking.chunk_coverage(df, F.col("n"), m, s, by=("n",)).collect()}
    want = {}
    for n in lengths:
        held = [0] * n
        for start in range(0, n - m + 1, s):
            for p in range(start, start + m):
                held[p] += 1
        for h in held:
            want[n, h] = want.get((n, h), 0) + 1
    assert got == want


def test_configurations_do_not_share_a_path():
    made = {files.chunk_path("x", f, "bytes", 8, 8, seed) for f in (None, 0.291, 0.299, 0.001, 0.002) for seed in (42, 123)}
    assert len(made) == 9


def test_long_documents_take_linear_time_without_compiled_code(spark):
    import time

    def seconds(n):
        df = spark.createDataFrame([(0, "x" * n)], "doc_id int, text string").select("doc_id", F.split("text", "").alias("input_ids"))
        start = time.perf_counter()
        assert chunking.chunk(df, 256, 200).count() == (n - 256) // 200 + 1
        return time.perf_counter() - start

    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    try:
        seconds(100_000)
        short, long = seconds(1_000_000), seconds(4_000_000)
    finally:
        spark.conf.unset("spark.sql.codegen.wholeStage")
    assert long < 6 * max(short, 0.5)


@pytest.mark.parametrize("m,s", [(3, 5), (1, 2), (4, 4), (4, 2), (2, 9)])
@pytest.mark.parametrize("block", [1, 3, 4096])
def test_uncovered_positions(spark, monkeypatch, m, s, block):
    monkeypatch.setattr(chunking, "GAP_BLOCK", block)
    lengths = [None, 0, 1, m - 1, m, m + 1, m + s - 1, m + s, 3 * s + m, 40]
    docs = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n int")
    want = set()
    for i, n in enumerate(lengths):
        starts = range(0, (n or 0) - m + 1, s)
        free = [p for p in range(n or 0) if not any(a <= p < a + m for a in starts)]
        for p in free:
            if p - 1 not in free:
                want.add((i, p, next(q for q in range(p, n + 1) if q not in free)))
    got = chunking.uncovered(docs, F.col("n"), m, s).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
