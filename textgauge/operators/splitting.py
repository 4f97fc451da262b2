"""Train/test splits and checks on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from textgauge.functions.ordering import SPLIT_SALT, below_share, order_hash
from textgauge.operators.sampling import find_cuts, held_out_rows
from textgauge.session import written


def split(
    df: DataFrame,
    keys: Sequence[str],
    test_size: float = 0.1,
    seed: int = 42,
    *,
    unit: str = "doc",
    exact: bool = False,
) -> DataFrame:
    """Adds ``split`` = ``train`` or ``test``.

    ``unit="doc"`` hashes the first key only, so that chunks of a document stay on one side;
    ``unit="chunk"`` hashes the whole key. The default is a hash share (no extra pass);
    ``exact=True`` puts exactly ``ceil(test_size * n)`` units on the test side.
    """
    if unit not in ("doc", "chunk"):
        raise ValueError(f"unit must be 'doc' or 'chunk', got {unit!r}")
    if not 0.0 < test_size < 1.0:
        raise ValueError(f"test_size must be in (0.0, 1.0), got {test_size}")
    used = list(keys[:1]) if unit == "doc" else list(keys)
    if exact:
        units = df.select(*used)
        if len(used) < len(keys):
            units = written(units.distinct(), "units")  # counting takes several passes
        _, cuts = find_cuts(units, used, [seed], lambda n: [held_out_rows(n, test_size)], SPLIT_SALT)
        held = cuts[seed][0].keeps(used)
    else:
        held = below_share(order_hash(seed, SPLIT_SALT, used), test_size)
    return df.withColumn("split", F.when(held, "test").otherwise("train"))


def split_profile(df: DataFrame) -> DataFrame:
    """One row: rows and percentage of both sides; an empty input has 0 %."""
    train = F.count_if(F.col("split") == "train")
    test = F.count_if(F.col("split") == "test")
    whole = F.greatest(F.count(F.lit(1)), F.lit(1))
    return df.agg(
        train.alias("train_rows"),
        (train * 100.0 / whole).alias("train_pct"),
        test.alias("test_rows"),
        (test * 100.0 / whole).alias("test_pct"),
    )


def split_overlap(train: DataFrame, test: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: distinct keys on the train side only, on the test side only, and on both.

    Both sides are tagged and counted per key in a single shuffle; partial aggregation leaves
    one row per key and task, so many chunks under one document key do no harm.
    """
    tagged = train.select(*keys, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        test.select(*keys, F.lit(0).alias("a"), F.lit(1).alias("b"))
    )
    per_key = tagged.groupBy(*keys).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return per_key.agg(
        F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("train_only"),
        F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("test_only"),
        F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("on_both"),
    )


def leaked_rows(train: DataFrame, test: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Test rows whose key also occurs in ``train``."""
    return test.join(train.select(*keys).distinct(), list(keys), "left_semi")
