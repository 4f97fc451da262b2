"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textgauge.session import shared_dir

#: Rows of two numbers that may be broadcast: below 64 MB in memory.
BROADCAST_ROWS = 1_000_000
#: Bytes of text that a Python worker takes at once from an Arrow batch.
SLICE_BYTES = 4_000_000


def saved(df: DataFrame, name: str) -> DataFrame:
    """Written below spark.checkpoint.dir and read again: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def column(df: DataFrame, name: str) -> F.Column:
    """The column of that name, also where the name holds dots or back-ticks."""
    return df["`" + name.replace("`", "``") + "`"]


def text_of(df: DataFrame, name: str) -> F.Column:
    return F.coalesce(column(df, name), F.lit(""))


def checked(small: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``small``, a written table of narrow rows, marked for broadcast if it is proven small.

    A larger one is joined by shuffling; the rows are the same.
    """
    return F.broadcast(small) if small.count() <= rows else small


def numbered(df: DataFrame, name: str) -> DataFrame:
    """With a row number that is unique, but neither dense nor stable until the rows are written."""
    return df.withColumn(name, F.monotonically_increasing_id())


def cut_batches(batch: pa.RecordBatch, at: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in consecutive parts of about ``size`` bytes of its text column ``at``.

    Bounds memory for any batch size; a longer text is a part of its own.
    """
    ends = np.cumsum(_lengths(batch.column(at)))
    start, before = 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
        yield batch.slice(start, stop - start)
        start, before = stop, int(ends[stop - 1])


def _lengths(texts: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
