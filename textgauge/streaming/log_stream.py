"""Run logs while they are written: repeated lines, running counts, and the checkpoints that a run keeps.

Lines arrive late and more than once, when files are copied or shipped again. Within the delay of the watermark each
counts once; later ones are dropped, which Spark reports as rows dropped by watermark. Counts are kept by key and given
out whenever they change; each micro-batch replaces its own folder, so a batch that is run again after a failure
changes nothing. Retention keeps a state of ``n + 1`` checkpoints for each run and gives out what enters and leaves it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textgauge.operators.runlogs import RUN

LINE = (*RUN, "ts", "level", "logger", "file", "line", "message")
CHECKPOINT = ("epoch", "ts", "eval_loss", "perplexity")


def unique_lines(lines: DataFrame, delay: str, identity: Sequence[str] = LINE) -> DataFrame:
    """Parsed lines, each once: a repeated one is left out if it arrives within ``delay`` of the newest line."""
    return lines.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(identity))


def run_totals(lines: DataFrame) -> DataFrame:
    """``(experiment, run_start, lines, first_at, last_at)``, batch or stream."""
    return lines.groupBy(*RUN).agg(F.count(F.lit(1)).alias("lines"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


def newest_runs(totals: DataFrame) -> DataFrame:
    """``(experiment, run_start, lines)`` of the newest run of every experiment, from :func:`run_totals`."""
    newest = totals.groupBy("experiment").agg(F.max_by(F.struct("run_start", "lines"), "run_start").alias("_r"))
    return newest.select("experiment", "_r.run_start", "_r.lines")


def start_updates(df: DataFrame, path: str, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Writes the rows that each micro-batch changes to ``path/batch=<number>``."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = df.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_updates(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The newest row of every key that :func:`start_updates` has written."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r"))
    return newest.select(*keys, *[f"_r.{c}" for c in rest])


def _last(row: tuple) -> tuple:
    """Order of the newest: epoch, then time, then loss, as Spark orders numbers."""
    epoch, ts, loss, _ = row
    return (_number(epoch), ts, _number(loss))


def _best(row: tuple) -> tuple:
    epoch, ts, loss, _ = row
    return (_number(loss), _number(epoch), ts)


def _number(x: float | None) -> tuple[bool, float]:
    """Not a number, here None, is greater than any number."""
    return (x is None, x or 0.0)


def _plain(values: list[float]) -> list[float | None]:
    """NaN as None, which equals itself."""
    return [None if math.isnan(x) else x for x in values]


def retention_changes(metrics: DataFrame, n: int = 2) -> DataFrame:
    """``(experiment, run_start, version, kept, is_best, epoch, ts, eval_loss, perplexity)``: what changes in the
    set of checkpoints that a run keeps, the last ``n`` and the best.

    ``metrics`` is a stream of evaluations without repetitions. A row with ``kept`` tells that a checkpoint is in the set, and whether it is the best;
    one without, that it left. Versions count the changes of a run.
    """
    if n < 1:
        raise ValueError(f"n must be at least 1, got {n}")
    rows = metrics.filter(F.col("kind") == "epoch")
    typed = {c: rows.schema[c].dataType.simpleString() for c in (*RUN, *CHECKPOINT)}
    of_run = ", ".join(f"{c} {typed[c]}" for c in RUN)
    of_row = ", ".join(f"{c} {typed[c]}" for c in CHECKPOINT)

    def step(key: tuple, parts: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        version, held = 0, []
        if state.exists:
            version, *columns = state.get
            held = [tuple(r) for r in zip(*columns)]
        old = {r: i == 0 for i, r in enumerate(held)}  # the best stands first
        now = held
        for part in filter(len, parts):  # batch by batch: no more than a batch and the state is in memory
            times = pd.DatetimeIndex(part["ts"]).as_unit("us").asi8
            epochs, losses, perplexities = (_plain(part[c].tolist()) for c in ("epoch", "eval_loss", "perplexity"))
            new = list(zip(epochs, times.tolist(), losses, perplexities))
            every = sorted({*now, *new}, key=_last)
            best = min(every, key=_best)
            now = [best, *(r for r in every[-n:] if r != best)]
        new_set = {r: i == 0 for i, r in enumerate(now)}
        changes = [(True, b, r) for r, b in new_set.items() if old.get(r) is not b] + [(False, False, r) for r in old if r not in new_set]
        if not changes:
            return
        version += 1
        state.update((version, *(list(c) for c in zip(*now))))
        out = pd.DataFrame([(*key, version, kept, is_best, *r) for kept, is_best, r in changes], columns=[*RUN, "version", "kept", "is_best", *CHECKPOINT])
        out["ts"] = pd.to_datetime(out["ts"], unit="us")
        yield out

    changes = rows.select(*RUN, *CHECKPOINT).groupBy(*RUN).applyInPandasWithState(
        step,
        f"{of_run}, version long, kept boolean, is_best boolean, {of_row}",
        "version long, epochs array<double>, times array<long>, losses array<double>, perplexities array<double>",
        "append",
        GroupStateTimeout.NoTimeout,
    )
    # an evaluation always has numbers: what came back without one was not a number
    return changes.withColumns({c: F.coalesce(c, F.lit(math.nan)) for c in ("epoch", "eval_loss", "perplexity")})


def current_retention(changes: DataFrame) -> DataFrame:
    """``(*run, epoch, ts, eval_loss, perplexity, is_best)`` of the checkpoints kept after all changes."""
    newest = changes.groupBy(*RUN, *CHECKPOINT).agg(F.max_by(F.struct("kept", "is_best"), "version").alias("_r"))
    return newest.filter("_r.kept").select(*RUN, *CHECKPOINT, F.col("_r.is_best").alias("is_best"))
