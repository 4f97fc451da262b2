"""Chunk tables on disk, one folder per configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

def fraction_label(fraction: float | None) -> str:
    """``full``, or the truncated percentage: 0.29 * 100 is 28.999... and becomes 28pct."""
    if fraction is None or fraction >= 1.0:
        return "full"
    return f"{int(fraction * 100)}pct"


def chunk_path(
    base: str,
    fraction: float | None,
    tokenizer: str,
    max_length: int,
    stride: int,
    seed: int | None = None,
) -> str:
    """Tokenizer, length, stride, fraction and seed are part of the name: no two runs share one.

    The short label is followed by the exact fraction and the seed of a subsample.
    """
    name = f"{tokenizer}_m{max_length}_s{stride}_{fraction_label(fraction)}"
    if fraction is not None and fraction < 1.0:
        name += f"_f{fraction!r}" + ("" if seed is None else f"_seed{seed}")
    return f"{base.rstrip('/')}/{name}"


def write_chunks(
    df: DataFrame,
    base: str,
    *,
    fraction: float | None = None,
    tokenizer: str,
    max_length: int,
    stride: int,
    seed: int | None = None,
) -> tuple[str, int]:
    """Write once, fail if the folder exists; returns the path and the rows written.

    The rows are counted while they are written. A ``labels`` column is stored if ``df`` has one;
    labels that just repeat the inputs need not be, :func:`read_chunks` adds them.
    """
    path = chunk_path(base, fraction, tokenizer, max_length, stride, seed)
    seen = Observation()
    out = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    out.write.mode("errorifexists").parquet(path)
    return path, seen.get["rows"]


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Size on disk from the file listing; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, chunk_idx, start, input_ids, labels)``.

    Labels are a copy of the inputs unless others were stored: keeping the copy on disk would
    double the size of the table and the time to write it.
    """
    df = spark.read.parquet(path)
    return df if "labels" in df.columns else df.withColumn("labels", F.col("input_ids"))
