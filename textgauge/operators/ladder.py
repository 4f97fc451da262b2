"""Run grids, nested data fractions and run budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textgauge.functions.ordering import SAMPLE_SALT, order_hash
from textgauge.operators.sampling import Cut, check_fraction, find_cuts, subset_size

# The default ablation grid, and per tier the batch per device and the
# accumulation steps of a single device.
MODELS = ("gpt2", "distilgpt2", "gpt2-medium")
FRACTIONS = (0.01, 0.05, 0.10, 0.25, 0.50, 1.0)
SEEDS = (42, 123, 456)
TIERS = {"low_vram": (4, 8), "high_throughput": (16, 2), "default": (8, 4)}
EPOCHS = 3


def _values(values: Sequence) -> Column:
    return F.array(*[F.lit(v) for v in values])


def with_run_grid(
    df: DataFrame,
    models: Sequence[str] = MODELS,
    fractions: Sequence[float] = FRACTIONS,
    seeds: Sequence[int] = SEEDS,
) -> DataFrame:
    """Every row of ``df`` once per run, in model, fraction, seed order as ``run_idx``."""
    for f in fractions:
        check_fraction(f)
    out = df.select("*", F.posexplode(_values(models)).alias("_m", "model_name"))
    out = out.select("*", F.posexplode(_values([float(f) for f in fractions])).alias("_f", "data_fraction"))
    out = out.select("*", F.posexplode(_values(seeds)).alias("_s", "seed"))
    idx = (F.col("_m") * len(fractions) + F.col("_f")) * len(seeds) + F.col("_s")
    return out.withColumn("run_idx", idx).drop("_m", "_f", "_s")


def run_grid(spark: SparkSession, **axes: Sequence) -> DataFrame:
    """``(run_idx, model_name, data_fraction, seed)``."""
    runs = with_run_grid(spark.range(1).select(), **axes)
    return runs.select("run_idx", "model_name", "data_fraction", "seed")


def rung_of(cuts: Sequence[Cut], keys: Sequence[str], hash_col: Column | None = None) -> Column:
    """Position (from 0) of the smallest fraction that holds a row; NULL if none does.

    ``cuts`` ascend in size. Fractions nest, so a row is in every later one too.
    """
    held = F.lit(None).cast("int")
    for i in range(len(cuts) - 1, -1, -1):
        held = F.when(cuts[i].keeps(keys, hash_col), i).otherwise(held)
    return held


def fraction_ladder(
    df: DataFrame,
    fractions: Sequence[float],
    seeds: Sequence[int],
    keys: Sequence[str],
    measures: Sequence[str],
) -> DataFrame:
    """``(seed, fraction, docs, *measures)``: totals of the exact subset of every run.

    One pass for all runs: each row is put on its lowest rung per seed, rungs are summed, and
    the few sums are accumulated. Rows are not repeated per fraction.
    """
    steps = sorted(set(fractions))
    for f in steps:
        check_fraction(f)
    _, cuts = find_cuts(df, keys, seeds, lambda n: [subset_size(n, f) for f in steps])
    places = F.array(
        *[
            F.struct(
                F.lit(s).alias("seed"),
                rung_of(cuts[s], keys, order_hash(s, SAMPLE_SALT, keys)).alias("rung"),
            )
            for s in seeds
        ]
    )
    placed = df.select(*measures, F.inline(places)).filter(F.col("rung").isNotNull())
    sums = placed.groupBy("seed", "rung").agg(
        F.count(F.lit(1)).alias("docs"), *[F.sum(m).alias(m) for m in measures]
    )
    # a rung adds its rows to its own and all higher fractions; at most rungs^2 rows per seed
    up = sums.withColumn("step", F.explode(F.sequence("rung", F.lit(len(steps) - 1))))
    totals = up.groupBy("seed", "step").agg(*[F.sum(c).alias(c) for c in ("docs", *measures)])
    fraction = F.element_at(_values([float(f) for f in steps]), F.col("step") + 1)
    return totals.select("seed", fraction.alias("fraction"), "docs", *measures)


def run_budget(
    ladder: DataFrame,
    max_length: int,
    *,
    tiers: dict[str, tuple[int, int]] | None = None,
    epochs: int = EPOCHS,
    world: int = 1,
    chunks: str = "chunks",
) -> DataFrame:
    """Optimizer steps and tokens of every ladder row under every resource tier.

    The effective batch is batch per device x accumulation x devices, where accumulation
    shrinks with the devices; the last, partly filled batch of an epoch counts as a step.
    """
    rows = [
        F.struct(
            F.lit(name).alias("tier"),
            F.lit(batch * max(accumulation // world, 1) * world).alias("effective_batch"),
        )
        for name, (batch, accumulation) in (TIERS if tiers is None else tiers).items()
    ]
    out = ladder.select("*", F.inline(F.array(*rows)))
    per_epoch = F.ceil(F.col(chunks) / F.col("effective_batch"))
    return out.withColumn("steps", (per_epoch * epochs).cast("long")).withColumn(
        "train_tokens", F.col(chunks) * (max_length * epochs)
    )
