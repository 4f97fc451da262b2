"""Cross-entropy and perplexity over chunks, logits and user models."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from textgauge.functions.scores import IGNORE_LABEL, cross_entropy, mean_loss, pass_at, perplexity_of
from textgauge.operators.tokenizing import once
from textgauge.operators.workers import once_per_worker


def shift_pairs(
    df: DataFrame, ids: str = "input_ids", keep: Sequence[str] = (), position: bool = False
) -> DataFrame:
    """``(*keep, [pos,] prev, next)``: each token with its successor inside one row."""
    n = F.size(ids)
    # slice raises on a negative length, which empty arrays would give
    rest = F.greatest(n - 1, F.lit(0))
    zipped = F.arrays_zip(
        F.slice(ids, F.lit(1), rest).alias("prev"), F.slice(ids, F.lit(2), rest).alias("next")
    )
    if position:
        flat = df.select(*keep, F.posexplode(zipped).alias("pos", "pair"))
        return flat.select(*keep, "pos", F.col("pair.prev").alias("prev"), F.col("pair.next").alias("next"))
    return df.select(*keep, F.inline(zipped).alias("prev", "next"))


def token_nll(
    df: DataFrame,
    logits: str = "logits",
    label: str = "label",
    *,
    ignore: int = IGNORE_LABEL,
    pad_id: int | None = None,
) -> DataFrame:
    """Adds ``nll`` and drops ignored labels, also those equal to ``pad_id`` if given.

    A label outside its logits raises.
    """
    wanted = F.col(label) != ignore
    if pad_id is not None:
        wanted &= F.col(label) != pad_id
    outside = (F.col(label) < 0) | (F.col(label) >= F.size(logits))
    checked = F.when(outside, F.raise_error(F.lit("a label lies outside its logits"))).otherwise(F.col(label))
    return df.filter(wanted).withColumn("nll", cross_entropy(F.col(logits), checked)).drop(logits)


def perplexity(
    df: DataFrame, nll: str = "nll", weight: str | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """``(*by, eval_loss, perplexity, n_tokens)``; NULL without tokens, infinity on overflow.

    ``weight`` says for how many tokens a row stands, when rows carry a mean loss. Rows without a
    loss count neither in the sum nor in ``n_tokens``.
    """
    w = F.when(F.col(nll).isNotNull(), F.lit(1) if weight is None else F.col(weight))
    sums = df.groupBy(*by).agg(
        F.sum(F.col(nll) * w).alias("_total"), F.coalesce(F.sum(w), F.lit(0)).alias("n_tokens")
    )
    loss = mean_loss(F.col("_total"), F.col("n_tokens"))
    return sums.select(
        *by, loss.alias("eval_loss"), perplexity_of(loss).alias("perplexity"), "n_tokens"
    )


def perplexity_by_chunk(
    df: DataFrame, chunk_keys: Sequence[str], nll: str = "nll", by: Sequence[str] = ()
) -> DataFrame:
    """Mean of per-chunk mean losses: every chunk weighs the same, whatever its tokens."""
    per_chunk = df.groupBy(*by, *chunk_keys).agg(F.avg(nll).alias("loss"))
    out = per_chunk.groupBy(*by).agg(
        F.avg("loss").alias("eval_loss"), F.count(F.lit(1)).alias("n_chunks")
    )
    return out.select(
        *by, "eval_loss", perplexity_of(F.col("eval_loss")).alias("perplexity"), "n_chunks"
    )


def score(
    chunks: DataFrame,
    make_predict_fn: Callable[[], Callable],
    max_length: int,
    batch: int = 16,
    ids: str = "input_ids",
) -> DataFrame:
    """Adds ``nll`` (mean over the chunk, by the user's model) and ``n_tokens``.

    ``make_predict_fn`` runs once per Python worker (load the model there) and returns a function from an
    ``[n, max_length]`` array of ids to ``n`` losses; it is called with at most ``batch`` chunks
    at a time. As all chunks are ``max_length`` long, an Arrow batch is such an array already,
    without a copy per chunk.
    """

    load = once_per_worker(make_predict_fn)

    @F.arrow_udf("double")
    def loss(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np

        predict = load()
        for column in columns:
            rows = len(column)
            flat = np.asarray(column.flatten())
            if len(flat) != rows * max_length or (np.diff(np.asarray(column.offsets)) != max_length).any():
                raise ValueError(f"all chunks must have {max_length} tokens")
            chunks = flat.reshape(rows, max_length)
            parts = [np.asarray(predict(chunks[i : i + batch]), float) for i in range(0, rows, batch)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    scored = chunks.withColumn("nll", once(loss)(ids))
    return scored.withColumn("n_tokens", F.lit(max_length - 1))


def pass_at_k(
    samples: DataFrame,
    ks: Sequence[int] = (1, 10),
    *,
    task: str = "task_id",
    passed: str = "passed",
) -> DataFrame:
    """``(task_id, n, c, pass_at_<k>...)`` from trusted ``passed`` flags."""
    counts = samples.groupBy(task).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(passed)).alias("c")
    )
    return counts.select(
        "*", *[pass_at(k, F.col("n"), F.col("c")).alias(f"pass_at_{k}") for k in ks]
    )


def mean_pass_at_k(per_task: DataFrame, ks: Sequence[int] = (1, 10)) -> DataFrame:
    """One row; a k that some task has too few samples for is NULL (not reported)."""

    def mean(k: int) -> Column:
        value = F.col(f"pass_at_{k}")
        return F.when(F.bool_and(F.col("n") >= k), F.avg(value)).alias(f"pass_at_{k}")

    return per_task.agg(F.count(F.lit(1)).alias("tasks"), *[mean(k) for k in ks])
