"""Chunking as a stream: windows need no state, so the batch expressions run unchanged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from textgauge.operators.chunking import chunk
from textgauge.operators.tokenizing import byte_tokenize


def read_corpus_stream(
    spark: SparkSession,
    folder: str,
    schema: str = "doc_id long, text string",
    *,
    pattern: str | None = None,
    max_files: int | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """New Parquet files of a folder as a stream of documents.

    ``partitions`` rehashes each batch, for sources that bring few large files at a time.
    """
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    docs = reader.parquet(folder)
    return docs.repartition(partitions, "doc_id") if partitions else docs


def chunk_stream(
    docs: DataFrame,
    max_length: int,
    stride: int | None = None,
    tokenize: Callable[[DataFrame], DataFrame] = byte_tokenize,
) -> DataFrame:
    """Windows of each arriving document; labels are added when the chunks are read."""
    return chunk(tokenize(docs), max_length, stride)


def start_append(
    df: DataFrame, path: str, checkpoint: str, *, available_now: bool = True
) -> StreamingQuery:
    """Exactly-once append to Parquet; a restart with the same checkpoint goes on behind it."""
    writer = (
        df.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
