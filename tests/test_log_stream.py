"""Live logs: repeated and late lines, restarts, retention against the batch operators."""

import random

import pytest

from textgauge.operators import runlogs
from textgauge.sources import run_logs
from textgauge.streaming import chunk_stream, log_stream

LINE = "2026-05-{:02d} 17:{:02d}:00 | INFO     | train                     | t.src:9 | Epoch {:.2f} | eval_loss: {} | perplexity: 4.00"
RUNS = ("a_2026-05-01_000000", "a_2026-05-02_000000", "b_2026-05-01_000000")


def made(rng):
    losses = ["1.5000", "1.4000", "1.4000", "inf", "nan", "0.9000", "2.0000"]
    return {run: [LINE.format(3 + i // 50, i % 50, i / 4, rng.choice(losses)) for i in range(rng.randint(20, 120))] for run in RUNS}


def deliver(folder, turn, lines):
    for run, own in lines.items():
        if own:
            (folder / f"{run}.log.{turn}").write_text("\n".join(own) + "\n")


def key(row):
    return tuple(map(repr, row))


@pytest.mark.parametrize("seed", [1, 2])
def test_streams_over_restarts_equal_batch(spark, tmp_path, seed):
    rng, box = random.Random(seed), tmp_path / "in"
    box.mkdir()
    lines = made(rng)
    for turn in range(3):
        part = {run: own[turn * len(own) // 3 : (turn + 1) * len(own) // 3] for run, own in lines.items()}
        again = {run: rng.sample(own[: (turn + 1) * len(own) // 3], 3) for run, own in lines.items()}
        shuffled = {run: rng.sample(part[run] + again[run], len(part[run]) + 3) for run in RUNS}
        deliver(box, turn, shuffled)
        logs = run_logs.read_run_logs(spark, str(box), stream=True, max_files=2)
        unique = log_stream.unique_lines(logs, "30 days")
        chunk_stream.start_append(unique, str(tmp_path / "lines"), str(tmp_path / "c1")).awaitTermination()
        kept = spark.readStream.schema(unique.schema).parquet(str(tmp_path / "lines"))
        log_stream.start_updates(log_stream.run_totals(kept), str(tmp_path / "totals"), str(tmp_path / "c2")).awaitTermination()
        changes = log_stream.retention_changes(runlogs.extract_metrics(kept), n=3)
        chunk_stream.start_append(changes, str(tmp_path / "changes"), str(tmp_path / "c3")).awaitTermination()
    whole = run_logs.read_run_logs(spark, str(box)).distinct()
    assert whole.count() == sum(len(set(own)) for own in lines.values())
    totals = log_stream.read_updates(spark, str(tmp_path / "totals"), runlogs.RUN)
    columns = ["experiment", "run_start", "lines", "first_at", "last_at"]
    assert sorted(map(key, totals.select(*columns).collect())) == sorted(map(key, log_stream.run_totals(whole).select(*columns).collect()))
    assert sorted(map(key, log_stream.newest_runs(totals).collect())) == sorted(map(key, runlogs.latest_runs(whole).collect()))
    found = spark.read.parquet(str(tmp_path / "changes"))
    columns = ["experiment", "run_start", "epoch", "ts", "eval_loss", "perplexity", "is_best"]
    kept = log_stream.current_retention(found)
    want = runlogs.retained_checkpoints(runlogs.extract_metrics(whole), n=3)
    assert sorted(map(key, kept.select(*columns).collect())) == sorted(map(key, want.select(*columns).collect()))
    best = runlogs.best_checkpoint(runlogs.extract_metrics(whole)).select("experiment", "run_start", "epoch")
    assert sorted(map(key, kept.filter("is_best").select("experiment", "run_start", "epoch").collect())) == sorted(map(key, best.collect()))


def test_lines_behind_the_delay_are_left_out(spark, tmp_path):
    box = tmp_path / "in"
    box.mkdir()
    late = LINE.format(3, 0, 0.25, "1.0000")
    for turn, own in enumerate(([LINE.format(20, 0, 1, "1.0000")], [LINE.format(21, 0, 2, "1.0000"), late])):
        deliver(box, turn, {RUNS[0]: own})
        lines = log_stream.unique_lines(run_logs.read_run_logs(spark, str(box), stream=True), "2 days")
        chunk_stream.start_append(lines, str(tmp_path / "lines"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "lines")).count() == 2


def test_a_repeated_micro_batch_changes_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 0), ("a", 3, 1), ("b", 2, 0)], "k string, n int, batch int")
    for b in (0, 1, 1):
        rows.filter(f"batch = {b}").drop("batch").write.mode("overwrite").parquet(str(tmp_path / f"batch={b}"))
    assert sorted(map(tuple, log_stream.read_updates(spark, str(tmp_path), ("k",)).collect())) == [("a", 3), ("b", 2)]


def test_retention_needs_a_number(spark):
    with pytest.raises(ValueError):
        log_stream.retention_changes(spark.createDataFrame([], "kind string"), n=0)
