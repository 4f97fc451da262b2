"""Evaluation studies: splits of saved chunks, model perplexity, sampled tasks, case studies."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from textgauge.functions.text import STOPS
from textgauge.operators.generation import compare_cases, generate, with_truncation
from textgauge.operators.sampling import subsample
from textgauge.operators.scoring import perplexity, score
from textgauge.operators.splitting import split, split_profile
from textgauge.sources.chunks import read_chunks
from textgauge.sources.reports import metric_table

CHUNK_KEYS = ["doc_id", "chunk_idx"]


def load_and_split(
    spark: SparkSession,
    path: str,
    fraction: float = 1.0,
    seed: int = 42,
    *,
    test_size: float = 0.1,
    unit: str = "chunk",
    exact: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Saved chunks, subsampled and marked ``train`` or ``test``; and the profile of the split.

    Both steps follow from the seed and the chunk keys, so an evaluation that is given the same
    fraction and seed as the training sees exactly the rows that were held out.
    """
    kept = subsample(read_chunks(spark, path), fraction, CHUNK_KEYS, seed)
    sides = split(kept, CHUNK_KEYS, test_size, seed, unit=unit, exact=exact)
    return sides, split_profile(sides)


def evaluate_model(
    chunks: DataFrame,
    make_predict_fn: Callable[[], Callable],
    max_length: int,
    batch: int = 16,
    by: Sequence[str] = (),
) -> DataFrame:
    """``(*by, eval_loss, perplexity, n_tokens)`` of a user model over chunks."""
    scored = score(chunks, make_predict_fn, max_length, batch)
    return perplexity(scored, weight="n_tokens", by=by)


def model_report(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The two metrics of :func:`evaluate_model` as a ``metric | value`` table."""
    names = {"eval_loss": "Cross-Entropy Loss", "perplexity": "Perplexity (PPL)"}
    return metric_table(metrics, names, keys=by)


def sample_tasks(
    tasks: DataFrame,
    make_fn: Callable[[], Callable[[list[str]], list[list[str]]]],
    n: int = 10,
    stops: Sequence[str] = STOPS,
) -> DataFrame:
    """``(task_id, sample_idx, completion)``: n completions per task, cut at the stop marks."""
    made = generate(tasks, make_fn, n, key="task_id")
    return with_truncation(made, stops=stops)


def case_study(
    prompts: DataFrame,
    baseline: Callable[[], Callable[[list[str]], list[list[str]]]],
    candidate: Callable[[], Callable[[list[str]], list[list[str]]]],
) -> DataFrame:
    """``(prompt_id, prompt, baseline, candidate)``: one completion of each model per prompt."""
    sides = (
        generate(prompts, make_fn, 1).select("prompt_id", "completion")
        for make_fn in (baseline, candidate)
    )
    return compare_cases(prompts.select("prompt_id", "prompt"), *sides)
