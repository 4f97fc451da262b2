"""Corpus reader: one key column and one text column out of any Spark format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_corpus(
    spark: SparkSession,
    path: str,
    text_col: str = "text",
    key_col: str = "doc_id",
    *,
    fmt: str = "parquet",
    schema: str | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``(doc_id, text, *keep)``; other columns are never read from a columnar file.

    ``schema`` spares JSON and CSV inputs the inference pass over the whole data.
    """
    reader = spark.read.format(fmt)
    if schema:
        reader = reader.schema(schema)
    df = reader.load(path)
    return df.select(F.col(key_col).alias("doc_id"), F.col(text_col).alias("text"), *keep)


def corpus_profile(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Documents, characters and bytes, plus documents without any text."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("docs"),
        F.sum(F.length("text")).alias("chars"),
        F.sum(F.octet_length("text")).alias("bytes"),
        F.count_if(F.coalesce(F.length("text"), F.lit(0)) == 0).alias("empty_docs"),
    )
