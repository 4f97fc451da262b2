"""Losses, perplexity and pass@k as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: labels with this id take no part in the loss.
IGNORE_LABEL = -100


def cross_entropy(logits: Column, label: Column) -> Column:
    """``-log softmax(logits)[label]`` by a stable log-sum-exp; ``label`` counts from 0.

    The maximum is the variable of an outer lambda: named directly inside the inner one it would
    be searched again for every element.
    """

    def log_sum_exp(top: Column) -> Column:
        return top + F.log(F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - top)))

    lse = F.transform(F.array(F.array_max(logits).cast("double")), log_sum_exp)
    return F.get(lse, F.lit(0)) - F.get(logits, label).cast("double")


def mean_loss(total: Column, count: Column) -> Column:
    """NULL without any scored token."""
    return F.when(count > 0, total / count)


def perplexity_of(loss: Column) -> Column:
    """``exp(loss)``; an overflow is infinity."""
    return F.exp(loss)


def smoothed_nll(pair: Column, context: Column, alpha: float, vocab_size: int | Column) -> Column:
    """Additive smoothing: ``-ln((pair + a) / (context + a * V))``; unseen counts are NULL."""
    a = F.lit(float(alpha))
    seen = F.coalesce(pair, F.lit(0)) + a
    mass = F.coalesce(context, F.lit(0)) + a * vocab_size
    return -F.log(seen / mass)


def pass_at(k: int, n: Column, c: Column) -> Column:
    """Unbiased estimate ``1 - C(n-c, k) / C(n, k)`` (Chen et al. 2021); NULL when n < k."""
    if k < 1:
        raise ValueError(f"k must be at least 1, got {k}")
    # The sequence stays behind the c = 0 test: it would run backwards there. Of its factors
    # 1 - k/i only c are needed, or k when that is fewer (the product is symmetric).
    by_c = F.aggregate(
        F.sequence(n - c + 1, n), F.lit(1.0), lambda acc, i: acc * (1.0 - F.lit(float(k)) / i)
    )
    by_k = F.aggregate(
        F.sequence(n - k + 1, n), F.lit(1.0), lambda acc, i: acc * (1.0 - c.cast("double") / i)
    )
    return (
        F.when(n < k, F.lit(None).cast("double"))
        .when(c == 0, 0.0)
        .when(n - c < k, 1.0)
        .when(c <= k, 1.0 - by_c)
        .otherwise(1.0 - by_k)
    )
