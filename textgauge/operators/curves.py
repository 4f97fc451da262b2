"""Series of run results: scaling curves and comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from textgauge.functions.scores import perplexity_of


def scaling_curve(
    metrics: DataFrame, by: Sequence[str] = (), fraction: str = "fraction", loss: str = "eval_loss"
) -> DataFrame:
    """Adds ``perplexity``, ``gain_prev`` (against the next smaller fraction) and ``gain_zero``.

    ``gain_zero`` compares with the row of fraction 0 and is NULL without one. Windows hold one
    row per fraction.
    """
    series = [F.col(c) for c in by] or [F.lit(0)]
    grow = W.partitionBy(*series).orderBy(fraction)
    whole = W.partitionBy(*series)
    zero = F.max(F.when(F.col(fraction) == 0, F.col(loss))).over(whole)
    return metrics.select(
        "*",
        perplexity_of(F.col(loss)).alias("perplexity"),
        (F.lag(loss).over(grow) - F.col(loss)).alias("gain_prev"),
        (zero - F.col(loss)).alias("gain_zero"),
    )


def compare_runs(
    metrics: DataFrame, variant: str, by: Sequence[str] = (), loss: str = "eval_loss"
) -> DataFrame:
    """Per variant the mean loss over its runs, its perplexity, rank and distance to the best.

    Runs are averaged before the ranking, whose window then holds one row per variant.
    """
    means = metrics.groupBy(*by, variant).agg(
        F.avg(loss).alias("eval_loss"), F.count(F.lit(1)).alias("runs")
    )
    series: list[Column] = [F.col(c) for c in by] or [F.lit(0)]
    order = W.partitionBy(*series).orderBy("eval_loss")
    return means.select(
        *by,
        variant,
        "runs",
        "eval_loss",
        perplexity_of(F.col("eval_loss")).alias("perplexity"),
        F.rank().over(order).alias("rank"),
        (F.col("eval_loss") - F.first("eval_loss").over(order)).alias("behind_best"),
    )
