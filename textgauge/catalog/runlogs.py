"""Queries on run logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from textgauge.catalog.base import (
    LOG_SQL,
    log_lines,
    logs,
    query,
    run_day,
    run_metrics,
    saved,
    stamp,
    table,
)
from textgauge.functions import text
from textgauge.operators import runlogs
from textgauge.session import shared_dir
from textgauge.sources import run_logs
from textgauge.streaming import chunk_stream, log_stream


@query(
    f"""
    WITH {LOG_SQL}
    SELECT experiment, run_day, stamp,
           CASE event_type WHEN 'purchase' THEN 'epoch' WHEN 'view' THEN 'split'
                WHEN 'signup' THEN 'chunking' ELSE 'final' END AS kind,
           epoch, eval_loss, perplexity,
           CASE WHEN event_type = 'signup' THEN user_id::DOUBLE END AS chunks,
           CASE WHEN event_type = 'signup' THEN event_id::DOUBLE END AS documents,
           CASE WHEN event_type = 'signup' THEN 0::DOUBLE END AS discarded,
           CASE WHEN event_type = 'view' THEN event_id::DOUBLE END AS train_chunks,
           CASE WHEN event_type = 'view' THEN user_id::DOUBLE END AS val_chunks
    FROM logs WHERE event_type <> 'click'"""
)
def log_metrics(spark, sf):
    return run_metrics(spark, sf).select(
        "experiment", run_day(), stamp(), "kind", "epoch", "eval_loss", "perplexity",
        "chunks", "documents", "discarded", "train_chunks", "val_chunks",
    )


# Message formats with the metric that the first number of each gives.
FORMATS = (
    ("raw", "Raw dataset loaded: %d documents.", "documents"),
    ("tokenizer", "Tokenizer loaded: vocab_size=%d, pad_token='<p1>', eos_token='</s>'.", "vocab_size"),
    ("total_chunks", "  • Total chunks:     %d", "chunks"),
    ("total_tokens", "  • Total tokens:     %d", "tokens"),
    ("chunk_length", "  • Tokens per chunk: %d", "chunk_length"),
    ("chunk_stride", "  • Chunk stride:     %d", "stride"),
    ("loaded", "Dataset loaded: %d total chunks.", "chunks"),
    ("saved", "Dataset saved (%d chunks, 2.5 MB on disk).", "chunks"),
    ("subsample", "Subsampled %d / 7 chunks (50.0%%) for ablation study.", "kept"),
    (None, "Raw dataset loaded: %d documents. Done", None),
)
FORMAT_COLUMNS = ("documents", "vocab_size", "chunks", "tokens", "chunk_length", "stride", "kept", "total", "megabytes")


def _format_sql(metric: str) -> str:
    own = [i for i, f in enumerate(FORMATS) if f[2] == metric]
    whens = [f"WHEN event_id % {len(FORMATS)} = {i} THEN user_id::DOUBLE" for i in own]
    if metric in ("total", "megabytes"):
        kind, value = ("subsample", 7.0) if metric == "total" else ("saved", 2.5)
        whens = [f"WHEN event_id % {len(FORMATS)} = {[f[0] for f in FORMATS].index(kind)} THEN {value}::DOUBLE"]
    return f"CASE {' '.join(whens)} END AS {metric}"


@query(
    f"""
    SELECT event_id, ['{"', '".join(str(f[0]) for f in FORMATS)}'][event_id % {len(FORMATS)} + 1] AS kind,
           {", ".join(map(_format_sql, FORMAT_COLUMNS))}
    FROM events WHERE event_id % {len(FORMATS)} <> {len(FORMATS) - 1}"""
)
def log_formats(spark, sf):
    """Messages of the other formats, one for each event, and one that only starts like them."""
    which = F.pmod("event_id", F.lit(len(FORMATS)))
    message = F.lit(None)
    for i, (_, text, _) in enumerate(FORMATS):
        message = F.when(which == i, F.format_string(text, "user_id")).otherwise(message)
    lines = table(spark, sf, "events").select("event_id", "ts", message.alias("message"))
    return runlogs.extract_metrics(lines, keep=("event_id",)).select("event_id", "kind", *FORMAT_COLUMNS)


CHECKPOINT_SQL = f"""
    {LOG_SQL},
    e AS (SELECT DISTINCT experiment, run_day, epoch, stamp, eval_loss, perplexity
          FROM logs WHERE event_type = 'purchase')"""


@query(
    f"""
    WITH {CHECKPOINT_SQL}
    SELECT experiment, run_day, epoch, eval_loss, perplexity FROM e
    QUALIFY row_number() OVER (PARTITION BY experiment, run_day ORDER BY eval_loss, epoch, stamp) = 1"""
)
def best_checkpoint(spark, sf):
    best = runlogs.best_checkpoint(run_metrics(spark, sf))
    return best.select("experiment", run_day(), "epoch", "eval_loss", "perplexity")


@query(
    f"""
    WITH {CHECKPOINT_SQL},
    r AS (SELECT *, row_number() OVER (PARTITION BY experiment, run_day ORDER BY eval_loss, epoch, stamp) AS b,
                 row_number() OVER (PARTITION BY experiment, run_day
                                    ORDER BY epoch DESC, stamp DESC, eval_loss DESC) AS l
          FROM e)
    SELECT experiment, run_day, epoch, stamp, eval_loss, (b = 1)::INT AS is_best
    FROM r WHERE b = 1 OR l <= 2"""
)
def retained_checkpoints(spark, sf):
    kept = runlogs.retained_checkpoints(run_metrics(spark, sf))
    return kept.select(
        "experiment", run_day(), "epoch", stamp(), "eval_loss", F.col("is_best").cast("int").alias("is_best")
    )


@query(
    f"""
    WITH {LOG_SQL}, r AS (SELECT experiment, run_day, count(*) AS lines FROM logs GROUP BY ALL)
    SELECT experiment, run_day, lines FROM r
    QUALIFY row_number() OVER (PARTITION BY experiment ORDER BY run_day DESC) = 1"""
)
def latest_runs(spark, sf):
    return runlogs.latest_runs(logs(spark, sf)).select("experiment", run_day(), "lines")


@query(
    f"""
    WITH {LOG_SQL}
    SELECT experiment, level, logger, count(*) AS messages FROM logs
    WHERE level <> 'DEBUG' GROUP BY ALL"""
)
def log_summary(spark, sf):
    return runlogs.log_summary(logs(spark, sf), by=("experiment",))


@query(
    f"""
    WITH {LOG_SQL}
    SELECT experiment, run_day, event_id AS step, eval_loss FROM logs
    WHERE event_type = 'purchase' AND event_id % 50 = 0"""
)
def every_n(spark, sf):
    metrics = runlogs.extract_metrics(logs(spark, sf), keep=(*runlogs.RUN, "event_id"))
    steps = metrics.filter(F.col("kind") == "epoch").withColumnRenamed("event_id", "step")
    return runlogs.every_n(steps).select("experiment", run_day(), "step", "eval_loss")


@query(
    f"""
    WITH {LOG_SQL}
    SELECT experiment, level, grouping_id(experiment, level)::INT AS grouped, count(*) AS messages,
           count(DISTINCT logger) AS loggers, max(stamp) AS stamp
    FROM logs GROUP BY GROUPING SETS ((experiment, level), (experiment), (level), ())"""
)
def log_rollup(spark, sf):
    made = runlogs.log_rollup(logs(spark, sf))
    return made.select("experiment", "level", "grouped", "messages", "loggers", stamp("last_at"))


# Lines of three stretches of time, delivered one after another; of the last five days of a stretch every
# seventh line comes with the next one, and every ninth comes with both.
DELAY = "10 days"


def _deliveries(spark, sf):
    """Log lines with the run's file name and the delivery that they come with."""
    times = table(spark, sf, "events").select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    low, high = times.agg(F.min("at"), F.max("at")).first()
    third = ((high or 0) - (low or 0)) // 3 + 1
    since = F.col("at") - (low or 0)
    own = F.floor(since / third).cast("int")
    last_days = (own < 2) & (since % third >= third - 5 * 86400)
    late, twice = last_days & (F.col("event_id") % 7 == 0), last_days & (F.col("event_id") % 9 == 0)
    turns = F.when(late, F.array(own + 1)).when(twice, F.array(own, own + 1)).otherwise(F.array(own))
    name = text.run_file_name(F.col("experiment"), F.col("run_start"))
    lines = log_lines(spark, sf).join(times, "event_id")
    return saved(lines.select(F.explode(turns).alias("turn"), name.alias("run"), "value"), "deliveries")


def _live(spark, sf, start):
    """Runs ``start(lines)`` after every delivery, each time as a new query on the same checkpoint."""
    rows, inbox = _deliveries(spark, sf), shared_dir(spark, "inbox")
    for turn in range(3):
        rows.filter(F.col("turn") == turn).drop("turn").write.mode("append").partitionBy("run").text(inbox)
        lines = run_logs.read_run_logs(spark, inbox, stream=True)
        start(log_stream.unique_lines(lines, DELAY)).awaitTermination()


LINES_SQL = f"""
    {LOG_SQL},
    u AS (SELECT DISTINCT experiment, run_day, stamp, level, logger, user_id, event_type, epoch, eval_loss, perplexity,
                 CASE event_type WHEN 'purchase' THEN concat_ws('|', epoch, printf('%.4f', value / 100), printf('%.2f', exp(value / 100)))
                      WHEN 'view' THEN event_id::VARCHAR WHEN 'signup' THEN event_id::VARCHAR
                      WHEN 'error' THEN concat_ws('|', printf('%.4f', value / 100), printf('%.2f', exp(value / 100)))
                      ELSE props END AS said
          FROM logs)"""


@query(
    f"""
    WITH {LINES_SQL}
    SELECT experiment, level, logger, count(*) AS messages FROM u WHERE level <> 'DEBUG' GROUP BY ALL"""
)
def live_log_summary(spark, sf):
    """Counts of a stream with late and repeated lines, over restarts."""
    made, clean, check = shared_dir(spark, "updates"), shared_dir(spark, "lines"), shared_dir(spark, "checkpoint")
    _live(spark, sf, lambda lines: chunk_stream.start_append(lines, clean, f"{check}/lines"))
    kept = spark.readStream.schema(spark.read.parquet(clean).schema).parquet(clean)
    counts = runlogs.log_summary(kept, by=("experiment",))
    log_stream.start_updates(counts, made, f"{check}/counts").awaitTermination()
    return log_stream.read_updates(spark, made, ("experiment", "level", "logger"))


@query(
    f"""
    WITH {LINES_SQL}, r AS (SELECT experiment, run_day, count(*) AS lines FROM u GROUP BY ALL)
    SELECT experiment, run_day, lines FROM r
    QUALIFY row_number() OVER (PARTITION BY experiment ORDER BY run_day DESC) = 1"""
)
def live_latest_runs(spark, sf):
    made, clean, check = shared_dir(spark, "updates"), shared_dir(spark, "lines"), shared_dir(spark, "checkpoint")

    def start(lines):
        chunk_stream.start_append(lines, clean, f"{check}/lines").awaitTermination()
        kept = spark.readStream.schema(lines.schema).parquet(clean)
        return log_stream.start_updates(log_stream.run_totals(kept), made, f"{check}/totals")

    _live(spark, sf, start)
    totals = log_stream.read_updates(spark, made, runlogs.RUN)
    return log_stream.newest_runs(totals).select("experiment", run_day(), "lines")


@query(
    f"""
    WITH {LINES_SQL}, e AS (SELECT DISTINCT experiment, run_day, epoch, stamp, eval_loss, perplexity FROM u WHERE event_type = 'purchase'),
    r AS (SELECT *, row_number() OVER (PARTITION BY experiment, run_day ORDER BY eval_loss, epoch, stamp) AS b,
                 row_number() OVER (PARTITION BY experiment, run_day ORDER BY epoch DESC, stamp DESC, eval_loss DESC) AS l
          FROM e)
    SELECT experiment, run_day, epoch, stamp, eval_loss, (b = 1)::INT AS is_best FROM r WHERE b = 1 OR l <= 2"""
)
def live_retention(spark, sf):
    """Checkpoints kept by a state per run that goes on over restarts."""
    made, clean, check = shared_dir(spark, "changes"), shared_dir(spark, "lines"), shared_dir(spark, "checkpoint")

    def start(lines):
        chunk_stream.start_append(lines, clean, f"{check}/lines").awaitTermination()
        kept = spark.readStream.schema(lines.schema).parquet(clean)
        changes = log_stream.retention_changes(runlogs.extract_metrics(kept))
        return chunk_stream.start_append(changes, made, f"{check}/changes")

    _live(spark, sf, start)
    kept = log_stream.current_retention(spark.read.parquet(made))
    return kept.select("experiment", run_day(), "epoch", stamp(), "eval_loss", F.col("is_best").cast("int").alias("is_best"))
