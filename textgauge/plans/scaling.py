"""Data-scaling study: how held-out loss falls as the training fraction grows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from textgauge.functions.ordering import SPLIT_SALT, below_share, order_hash
from textgauge.operators.countlm import count_byte_pairs, nested_losses
from textgauge.operators.curves import scaling_curve
from textgauge.operators.ladder import rung_of
from textgauge.operators.sampling import check_fraction, find_cuts, subset_size


def scaling_study(
    docs: DataFrame,
    fractions: Sequence[float] = (0.1, 0.5, 1.0),
    *,
    seed: int = 42,
    test_size: float = 0.1,
    max_length: int = 64,
    alpha: float = 1.0,
) -> DataFrame:
    """``(fraction, eval_loss, perplexity, n_tokens, gain_prev, gain_zero)`` from one corpus scan.

    Documents are split first, so every fraction is tested on the same held-out documents; the
    fractions are exact, nested subsets of the training documents. Byte tokens, bigram model.
    Each document is read, cut into windows and counted once, whatever the number of fractions.
    """
    steps = sorted(set(fractions))
    for f in steps:
        check_fraction(f)
    keys = ["doc_id"]
    held_out = below_share(order_hash(seed, SPLIT_SALT, keys), test_size)
    train = docs.filter(~held_out)
    _, cuts = find_cuts(train, keys, [seed], lambda n: [subset_size(n, f) for f in steps])
    rung = F.when(held_out, -1).otherwise(rung_of(cuts[seed], keys))
    placed = docs.select(rung.alias("rung"), "text").filter(F.col("rung").isNotNull())
    counts = count_byte_pairs(placed, max_length, by=("rung",))
    losses = nested_losses(counts, len(steps), 256, alpha)
    fraction = F.when(F.col("step") < 0, 0.0).otherwise(
        F.element_at(F.array(*[F.lit(float(f)) for f in steps]), F.greatest(F.col("step") + 1, F.lit(1)))
    )
    return scaling_curve(losses.select(fraction.alias("fraction"), "eval_loss", "n_tokens"))
