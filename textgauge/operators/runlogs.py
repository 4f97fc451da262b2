"""Analytics over parsed run logs."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

RUN = ("experiment", "run_start")

# Formats of the metric messages, as patterns, and the metric that each number of
# a message gives (None: a percentage that follows from the others).
_NUM = r"(?:-?\d+(?:\.\d+)?|-?\binf\b|\bnan\b)"
MESSAGES = {
    "epoch": (
        rf"^Epoch {_NUM} \| eval_loss: {_NUM} \| perplexity: {_NUM}$",
        ("epoch", "eval_loss", "perplexity"),
    ),
    "final": (
        rf"^Final — Validation Loss: {_NUM} \| Perplexity \(PPL\): {_NUM}$",
        ("eval_loss", "perplexity"),
    ),
    "chunking": (
        r"^Chunking complete: \d+ chunks from \d+ documents "
        r"\(~\d+ short docs discarded, \d+\.\d%\)\.$",
        ("chunks", "documents", "discarded", None),
    ),
    "split": (
        r"^Train / Val split: \d+ chunks \(\d+\.\d%\) / \d+ chunks \(\d+\.\d%\)\.$",
        ("train_chunks", None, "val_chunks", None),
    ),
    "subsample": (
        r"^Subsampled \d+ / \d+ (?:chunks|documents) \(\d+\.\d%\) for ablation(?: study)?\.$",
        ("kept", "total", None),
    ),
    "loaded": (r"^Dataset loaded: \d+ total chunks\.$", ("chunks",)),
    "saved": (r"^Dataset saved \(\d+ chunks, \d+\.\d MB on disk\)\.$", ("chunks", "megabytes")),
    "raw": (r"^Raw dataset loaded: \d+ documents\.$", ("documents",)),
    "tokenizer": (
        r"^Tokenizer loaded: vocab_size=\d+, pad_token='.*', eos_token='.*'\.$",
        ("vocab_size",),
    ),
    "total_chunks": (r"^  • Total chunks: +\d+$", ("chunks",)),
    "total_tokens": (r"^  • Total tokens: +\d+$", ("tokens",)),
    "chunk_length": (r"^  • Tokens per chunk: +\d+$", ("chunk_length",)),
    "chunk_stride": (r"^  • Chunk stride: +\d+$", ("stride",)),
}
METRICS = (
    "epoch", "eval_loss", "perplexity", "chunks", "documents", "discarded",
    "train_chunks", "val_chunks", "kept", "total", "megabytes",
    "vocab_size", "tokens", "chunk_length", "stride",
)

# Log levels in order, and loggers that only report from WARNING on.
LEVELS = {"DEBUG": 10, "INFO": 20, "WARNING": 30, "ERROR": 40, "CRITICAL": 50}
RAISED = {"transformers": "WARNING", "datasets": "WARNING", "accelerate": "INFO"}


# the part of a pattern before its first special character, and before a blank that may repeat
_FIXED_START = re.compile(r"(?:[^\\(\[.*+?{| ]| (?![+*?{]))*")


def extract_metrics(logs: DataFrame, keep: Sequence[str] = RUN) -> DataFrame:
    """``(*keep, ts, kind, <METRICS>)`` for messages of a known format, NULL where not given.

    A message is matched and its numbers are taken out once, inside a generator that also drops
    all other messages; the metric columns only index the numbers.
    """
    message = F.col("message")
    kind = F.lit(None).cast("string")
    for name, (pattern, _) in MESSAGES.items():
        # the fixed first words are compared before the pattern is tried
        known = message.startswith(_FIXED_START.match(pattern[1:])[0]) & message.rlike(pattern)
        kind = F.when(known, name).otherwise(kind)
    numbers = F.regexp_extract_all(message, F.lit(_NUM), F.lit(0))
    found = F.transform(
        F.array(kind),
        lambda k: F.when(k.isNotNull(), F.struct(k.alias("kind"), numbers.alias("numbers"))),
    )
    known = logs.select(*keep, "ts", F.explode(found).alias("_m")).filter(F.col("_m").isNotNull())

    def value(metric: str) -> Column:
        out = F.lit(None).cast("double")
        for name, (_, fields) in MESSAGES.items():
            if metric in fields:
                number = F.get("_m.numbers", F.lit(fields.index(metric))).try_cast("double")
                out = F.when(F.col("_m.kind") == name, number).otherwise(out)
        return out.alias(metric)

    return known.select(*keep, "ts", F.col("_m.kind").alias("kind"), *[value(m) for m in METRICS])


def _checkpoints(metrics: DataFrame) -> DataFrame:
    return metrics.filter(F.col("kind") == "epoch")


def best_checkpoint(metrics: DataFrame, by: Sequence[str] = RUN) -> DataFrame:
    """Per run the evaluation with the lowest loss; ties go to the earliest epoch."""
    row = F.struct("epoch", "ts", "eval_loss", "perplexity")
    order = F.struct("eval_loss", "epoch", "ts")
    best = _checkpoints(metrics).groupBy(*by).agg(F.min_by(row, order).alias("_b"))
    return best.select(*by, "_b.epoch", "_b.eval_loss", "_b.perplexity")


def retained_checkpoints(
    metrics: DataFrame, n: int = 2, by: Sequence[str] = RUN
) -> DataFrame:
    """The last ``n`` checkpoints of every run, and the best one.

    Each checkpoint competes once for the newest and once for the best, under one rank with a
    constant bound: Spark then keeps only the first rows of a group already before the shuffle
    (``WindowGroupLimit``), however many checkpoints a run has.
    """
    if n < 1:
        raise ValueError(f"n must be at least 1, got {n}")
    shown = ("epoch", "ts", "eval_loss", "perplexity")
    at = F.unix_micros("ts").cast("double")

    def entry(is_best: int, *order: Column) -> Column:
        names = ("first", "second", "third")
        parts = [col.alias(name) for col, name in zip(order, names)]
        return F.struct(F.lit(is_best).alias("is_best"), F.struct(*parts).alias("order"))

    entries = F.array(
        entry(0, -F.col("epoch"), -at, -F.col("eval_loss")),
        entry(1, F.col("eval_loss"), F.col("epoch"), at),
    )
    rows = _checkpoints(metrics).select(*by, *shown, F.inline(entries))
    place = F.row_number().over(W.partitionBy(*by, "is_best").orderBy("order"))
    kept = rows.withColumn("_r", place).filter(F.col("_r") <= n)
    kept = kept.filter((F.col("is_best") == 0) | (F.col("_r") == 1))
    return kept.groupBy(*by, *shown).agg(F.max("is_best").cast("boolean").alias("is_best"))


def latest_runs(logs: DataFrame) -> DataFrame:
    """``(experiment, run_start, lines)`` of the newest run of every experiment."""
    per_run = logs.groupBy(*RUN).agg(F.count(F.lit(1)).alias("lines"))
    newest = per_run.groupBy("experiment").agg(
        F.max_by(F.struct("run_start", "lines"), "run_start").alias("_r")
    )
    return newest.select("experiment", "_r.run_start", "_r.lines")


def log_summary(
    logs: DataFrame,
    min_level: str = "INFO",
    by: Sequence[str] = (),
    raised: Mapping[str, str] = RAISED,
) -> DataFrame:
    """``(*by, level, logger, messages)`` of what passes the threshold and the raised loggers."""
    if min_level not in LEVELS:
        raise ValueError(f"unknown level {min_level!r}")

    def rank(col: Column) -> Column:
        out = F.lit(None).cast("int")
        for name, value in LEVELS.items():
            out = F.when(col == name, value).otherwise(out)
        return out

    floor = F.lit(LEVELS[min_level])
    for logger, level in raised.items():
        # a raised logger and its children
        own = (F.col("logger") == logger) | F.col("logger").startswith(f"{logger}.")
        floor = F.when(own, max(LEVELS[level], LEVELS[min_level])).otherwise(floor)
    kept = logs.filter(rank(F.col("level")) >= floor)
    return kept.groupBy(*by, "level", "logger").agg(F.count(F.lit(1)).alias("messages"))


def log_rollup(logs: DataFrame) -> DataFrame:
    """``(experiment, level, grouped, messages, loggers, last_at)``: message counts by experiment and level, by each alone, and in all.

    ``grouped`` tells the row's grouping as bits, 0 for both columns; a column that is left out is NULL.
    """
    sets = [[F.col("experiment"), F.col("level")], [F.col("experiment")], [F.col("level")], []]
    made = logs.groupingSets(sets, "experiment", "level").agg(
        F.grouping_id().cast("int").alias("grouped"),
        F.count(F.lit(1)).alias("messages"),
        F.countDistinct("logger").alias("loggers"),
        F.max("ts").alias("last_at"),
    )
    return made.select("experiment", "level", "grouped", "messages", "loggers", "last_at")


def every_n(metrics: DataFrame, n: int = 50, step: str = "step") -> DataFrame:
    """Rows at every n-th step."""
    if n < 1:
        raise ValueError(f"n must be at least 1, got {n}")
    return metrics.filter(F.col(step) % n == 0)
