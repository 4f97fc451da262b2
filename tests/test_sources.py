"""Corpora, samples, prompts, run logs and reports."""

import json

import pytest
from textgauge import session
from textgauge.operators import runlogs
from textgauge.sources import corpus, reports, run_logs, samples

LINES = [
    "2026-05-06 16:34:52 | INFO     | prep                      | prep.src:436 | Saving dataset to: /tmp/x",
    "2026-05-06 16:34:53 | INFO     | prep                      | prep.src:446 | Dataset saved (1 chunks, 0.0 MB on disk).",
    "2026-05-06 15:54:35 | INFO     | test                      | <string>:1 | Logger validation OK",
    "2026-05-06 17:00:00 | \x1b[33mWARNING\x1b[0m | datasets                  | x.src:7 | \x1b[33mslow | very slow\x1b[0m",
    "Traceback (most recent call last):",
    "2026-05-06 17:00:01 | INFO     | train                     | t.src:9 | Epoch 1.00 | eval_loss: 1.4932 | perplexity: 4.45",
    "2026-05-06 17:00:02 | INFO     | train                     | t.src:9 | Epoch 2.00 | eval_loss: 1.3365 | perplexity: 3.81",
    "2026-05-06 17:00:03 | INFO     | train                     | t.src:9 | Epoch 3.00 | eval_loss: 1.3511 | perplexity: 3.86",
    "2026-05-06 17:00:04 | INFO     | train                     | t.src:9 | Epoch 4.00 | eval_loss: inf | perplexity: inf",
    "2026-05-06 17:00:05 | INFO     | train                     | t.src:9 | Final — Validation Loss: 1.3365 | Perplexity (PPL): 3.81",
    "2026-05-06 17:00:06 | INFO     | train                     | t.src:9 | Train / Val split: 90 chunks (90.0%) / 10 chunks (10.0%).",
    "2026-05-06 17:00:07 | INFO     | prep                      | p.src:9 | Chunking complete: 5 chunks from 9 documents (~4 short docs discarded, 44.4%).",
    "2026-05-06 17:00:08 | INFO     | prep                      | p.src:9 | Subsampled 3 / 30 chunks (10.0%) for ablation study.",
    "2026-05-06 17:00:09 | INFO     | prep                      | p.src:9 | Subsampled 3 / 30 documents (10.0%) for ablation.",
    "2026-05-06 17:00:10 | INFO     | prep                      | p.src:9 | Dataset loaded: 30 total chunks.",
    "2026-05-06 17:00:11 | DEBUG    | prep                      | p.src:9 | Epoch of change",
]


def test_corpus_columns_and_profile(spark, tmp_path, plan):
    df = spark.createDataFrame(
        [(1, "a", "äb", 9), (2, "b", None, 9), (3, "c", "", 9)], "k long, other string, code string, n int"
    )
    df.write.parquet(str(tmp_path / "p"))
    df.write.json(str(tmp_path / "j"))
    got = corpus.read_corpus(spark, str(tmp_path / "p"), "code", "k")
    assert got.columns == ["doc_id", "text"]
    assert "ReadSchema: struct<k:bigint,code:string>" in plan(got)
    assert tuple(corpus.corpus_profile(got).first()) == (3, 2, 3, 2)
    again = corpus.read_corpus(
        spark, str(tmp_path / "j"), "code", "k", fmt="json", schema="k long, code string"
    )
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect()))


def test_samples_keep_line_breaks(spark, tmp_path):
    rows = [("t/0", 1, 'a\n"b"\t\\'), ("t/0", 0, "")]
    df = spark.createDataFrame(rows, "task_id string, sample_idx int, completion string")
    samples.write_samples(df, str(tmp_path / "s"))
    got = samples.read_samples(spark, str(tmp_path / "s")).collect()
    assert sorted(map(tuple, got)) == sorted(rows)


def test_prompt_banks(spark, tmp_path):
    bank = ["def f():\n", 'say "hi"', "é\\n"]
    (tmp_path / "one.json").write_text(json.dumps(bank, indent=1), encoding="utf-8")
    got = samples.read_prompts(spark, str(tmp_path / "one.json")).orderBy("prompt_id").collect()
    assert [tuple(r) for r in got] == [("one.json", i, p) for i, p in enumerate(bank)]
    (tmp_path / "two.json").write_text("\n".join(json.dumps([p]) for p in bank), encoding="utf-8")
    lines = samples.read_prompts(spark, str(tmp_path / "two.json"), lines=True).collect()
    assert sorted(r["prompt"] for r in lines) == sorted(bank)
    assert samples.read_prompts(spark).count() == 15


def write_logs(folder):
    (folder / "abl-ation_x_2026-05-06_163452.log").write_text("\n".join(LINES) + "\n", encoding="utf-8")
    (folder / "abl-ation_x_2026-05-07_000001.log.1").write_text(LINES[5] + "\n", encoding="utf-8")
    (folder / "other_2026-01-01_000000.log").write_text(LINES[0] + "\n", encoding="utf-8")


def test_run_logs(spark, tmp_path):
    write_logs(tmp_path)
    logs = run_logs.read_run_logs(spark, str(tmp_path))
    first = logs.filter("run_start = timestamp'2026-05-06 16:34:52'")
    assert first.count() == len(LINES) - 1
    warning = first.filter("level = 'WARNING'").first()
    assert (warning["logger"], warning["file"], warning["line"]) == ("datasets", "x.src", 7)
    assert warning["message"] == "slow | very slow"
    assert first.filter("file = '<string>'").first()["logger"] == "test"
    runs = {(r["experiment"], str(r["run_start"]), r["lines"]) for r in runlogs.latest_runs(logs).collect()}
    assert runs == {("abl-ation_x", "2026-05-07 00:00:01", 1), ("other", "2026-01-01 00:00:00", 1)}


def test_run_logs_as_a_stream(spark, tmp_path):
    write_logs(tmp_path)
    logs = run_logs.read_run_logs(spark, str(tmp_path), stream=True)
    out, state = session.shared_dir(spark, "log-stream"), session.shared_dir(spark, "log-state")
    metrics = runlogs.extract_metrics(logs)
    query = (
        metrics.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    batch = runlogs.extract_metrics(run_logs.read_run_logs(spark, str(tmp_path)))
    stream = spark.read.schema(batch.schema).parquet(out)
    assert stream.count() == batch.count() > 0 and stream.exceptAll(batch).count() == 0


def test_metrics_and_checkpoints(spark, tmp_path):
    write_logs(tmp_path)
    logs = run_logs.read_run_logs(spark, str(tmp_path)).filter("run_start < '2026-05-07' AND line = 9")
    metrics = runlogs.extract_metrics(logs)
    by_kind = {}
    for r in metrics.orderBy("ts").collect():
        values = {k: v for k, v in r.asDict().items() if k in runlogs.METRICS and v is not None}
        by_kind.setdefault(r["kind"], []).append(values)
    assert by_kind["epoch"][0] == {"epoch": 1.0, "eval_loss": 1.4932, "perplexity": 4.45}
    assert by_kind["epoch"][3] == {"epoch": 4.0, "eval_loss": float("inf"), "perplexity": float("inf")}
    assert by_kind["final"] == [{"eval_loss": 1.3365, "perplexity": 3.81}]
    assert by_kind["split"] == [{"train_chunks": 90.0, "val_chunks": 10.0}]
    assert by_kind["chunking"] == [{"chunks": 5.0, "documents": 9.0, "discarded": 4.0}]
    assert by_kind["subsample"] == [{"kept": 3.0, "total": 30.0}] * 2
    assert by_kind["loaded"] == [{"chunks": 30.0}]
    best = runlogs.best_checkpoint(metrics).first()
    assert (best["epoch"], best["eval_loss"]) == (2.0, 1.3365)
    kept = runlogs.retained_checkpoints(metrics).orderBy("epoch").collect()
    assert [(r["epoch"], r["is_best"]) for r in kept] == [(2.0, True), (3.0, False), (4.0, False)]
    kept = runlogs.retained_checkpoints(metrics, n=1).orderBy("epoch").collect()
    assert [r["epoch"] for r in kept] == [2.0, 4.0]


def test_log_summary_thresholds(spark):
    rows = [
        ("DEBUG", "a"), ("INFO", "a"), ("INFO", "datasets"), ("WARNING", "datasets.x"),
        ("INFO", "datasets_own"), ("CRITICAL", "transformers"), ("INFO", "accelerate"), ("ODD", "a"),
    ]
    logs = spark.createDataFrame(rows, "level string, logger string")
    got = {(r["level"], r["logger"]) for r in runlogs.log_summary(logs).collect()}
    assert got == {
        ("INFO", "a"), ("WARNING", "datasets.x"), ("INFO", "datasets_own"),
        ("CRITICAL", "transformers"), ("INFO", "accelerate"),
    }
    errors = runlogs.log_summary(logs, "ERROR").collect()
    assert [(r["level"], r["messages"]) for r in errors] == [("CRITICAL", 1)]
    with pytest.raises(ValueError):
        runlogs.log_summary(logs, "LOUD")


def test_every_n(spark):
    steps = spark.range(0, 201).withColumnRenamed("id", "step")
    assert [r[0] for r in runlogs.every_n(steps).orderBy("step").collect()] == [0, 50, 100, 150, 200]


def test_case_report(spark):
    df = spark.createDataFrame(
        [(1, "p ```\n", "p\na```\n\n", "p\nb")], "case_idx int, prompt string, baseline string, candidate string"
    )
    got = reports.render_cases(df, ("old", "new")).first()["markdown"]
    want = (
        "## Case 1\n\n### Prompt\n\n```python\np ```\n```\n\n### old\n\n```python\np\na````\n```\n\n"
        "### new\n\n```python\np\nb\n```\n\n---\n"
    )
    assert got == want
    assert reports.report_head("T", "now").startswith("# T\n\n> Generated on now\n\n> Each case")


def test_metric_table(spark):
    df = spark.createDataFrame([(1.4860, float("inf"), None)], "a double, b double, c double")
    rows = reports.metric_table(df, {"a": "Loss", "b": "PPL", "c": "pass@10"}).collect()
    assert [tuple(r) for r in rows] == [("Loss", "1.4860"), ("PPL", "inf")]


class FakeSession:
    """Just the settings that shared_dir looks at."""

    def __init__(self, master, **settings):
        self.settings = settings
        self.conf = self
        self.sparkContext = self
        self.master = master

    def get(self, key, default):
        return self.settings.get(key, default)


def test_shared_dir_follows_the_session():
    named = FakeSession("spark://host", **{"spark.checkpoint.dir": "hdfs://place/x/"})
    first, second = (session.shared_dir(named, "t") for _ in range(2))
    assert first.startswith("hdfs://place/x/textgauge/t-") and first != second
    assert "textgauge" in session.shared_dir(FakeSession("local[2]"), "t")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(FakeSession("spark://host"), "t")


def test_spread_is_off_unless_asked_for(spark):
    wide = spark.range(100, numPartitions=50)
    asked = spark.conf.get("spark.textgauge.spread")
    assert session.spread(wide, "id").rdd.getNumPartitions() == int(asked)
    spark.conf.unset("spark.textgauge.spread")
    try:
        assert session.spread(wide, "id") is wide
    finally:
        spark.conf.set("spark.textgauge.spread", asked)


def test_lines_with_other_line_separators(spark):
    from pyspark.sql import Observation

    head = "2025-01-02 03:04:05 | INFO     | train | a.py:7 | "
    messages = ["plain", "with separator", "next\u0085line", "para graph"]
    df = spark.createDataFrame([(head + m,) for m in messages] + [("Traceback (most recent call last):",)], "value string")
    seen = Observation()
    got = run_logs.parse_lines(df, seen=seen).collect()
    assert sorted(r["message"] for r in got) == sorted(messages)
    assert seen.get == {"lines": 5, "other_lines": 1}
