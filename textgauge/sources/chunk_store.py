"""Chunk tables in buckets of their document, sorted: checks and joins by document read them without moving a chunk.

A bucketed table has its number of buckets in the catalog, not in its files. Sessions that did not write it declare it again with
:func:`declare_bucketed`. A document is in one bucket, so the largest document must fit a task's disk;
:func:`bucket_count` keeps the buckets of a growing table as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from textgauge.functions.windows import check_window, window_count

KEYS, SORT = ("doc_id",), ("doc_id", "chunk_idx")


#: Tokens of a document table for each bucket: a task that sorts a bucket's chunks holds some hundred MB.
BUCKET_TOKENS = 32_000_000


def bucket_count(docs: DataFrame, length: Column, least: int = 8, tokens: int = BUCKET_TOKENS) -> int:
    """Buckets for the chunks of ``docs``, given their numbers of tokens: in proportion to these, so that no task grows with the table."""
    total = docs.agg(F.sum(length.cast("long")).alias("n")).first()["n"] or 0
    return max(least, -(-total // tokens))


def write_bucketed(
    df: DataFrame, table: str, path: str, buckets: int, keys: Sequence[str] = KEYS, sort: Sequence[str] = SORT
) -> DataFrame:
    """Writes ``df`` once, under ``path``, as the catalog's ``table``; fails if there is one.

    Rows are dealt out by the keys first, so that every bucket is one file and its order holds on reading.
    """
    dealt = df.repartition(buckets, *keys)
    writer = dealt.write.format("parquet").mode("errorifexists").option("path", path)
    writer.bucketBy(buckets, *keys).sortBy(*sort).saveAsTable(table)
    return df.sparkSession.table(table)


def declare_bucketed(
    spark: SparkSession, table: str, path: str, buckets: int, keys: Sequence[str] = KEYS, sort: Sequence[str] = SORT
) -> DataFrame:
    """The table that :func:`write_bucketed` wrote to ``path``, in another session."""

    def names(columns: Sequence[str]) -> str:
        return ", ".join("`" + c.replace("`", "``") + "`" for c in columns)

    columns = ", ".join(f"{names([f.name])} {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({names(keys)}) SORTED BY ({names(sort)})"
        f" INTO {buckets} BUCKETS LOCATION '{place}'"
    )
    return spark.table(table)


def verify_stored(
    chunks: DataFrame, docs: DataFrame, max_length: int, stride: int, ids: str = "input_ids"
) -> DataFrame:
    """The row that ``operators.chunking.verify_chunks`` gives, for chunks and source ids in equal buckets of ``doc_id``.

    Each chunk meets its document's ids by a merge join of sorted buckets; neighbours follow each other in the same
    order. Only counts leave a task.
    """
    check_window(max_length, stride)
    source = docs.select(F.col("doc_id"), F.col(ids).alias("_ids"))
    own = chunks.select(F.col("doc_id"), "chunk_idx", "input_ids")
    # an outer join of both sides would lose the buckets: documents without a chunk are counted apart
    rows = own.join(source, "doc_id", "left")
    due = window_count(F.coalesce(F.size("_ids"), F.lit(0)), max_length, stride)
    shared = max(max_length - stride, 0)
    there = F.col("chunk_idx").isNotNull()
    inside = there & (F.col("chunk_idx") >= 0) & (F.col("chunk_idx") < due)
    same = F.slice("_ids", (F.col("chunk_idx") * stride + 1).cast("int"), F.lit(max_length))
    in_order = W.partitionBy("doc_id").orderBy("chunk_idx")
    tail = F.xxhash64(F.slice("input_ids", F.lit(stride + 1), F.lit(shared)))
    head = F.xxhash64(F.slice("input_ids", F.lit(1), F.lit(shared)))
    rows = rows.select(
        "doc_id",
        "chunk_idx",
        due.alias("due"),
        inside.alias("inside"),
        (there & (F.size("input_ids") != max_length)).cast("int").alias("wrong"),
        F.when(inside, F.col("input_ids") != same).alias("differs"),
        head.alias("head"),
        F.lag("chunk_idx").over(in_order).alias("before"),
        F.lag(tail).over(in_order).alias("tail"),
    )
    follows = F.col("before") == F.col("chunk_idx") - 1
    again = F.coalesce(F.col("before") == F.col("chunk_idx"), F.lit(False))
    per_doc = rows.groupBy("doc_id").agg(
        F.count("chunk_idx").alias("chunks"),
        F.count_if(follows).alias("neighbours"),
        F.sum("wrong").alias("wrong_length"),
        F.max("due").alias("due"),
        F.count_if(F.col("inside") & ~again).alias("distinct"),
        F.count_if((F.col("chunk_idx").isNotNull() & ~F.col("inside")) & ~again).alias("extra"),
        F.countDistinct(F.when(F.col("inside") & again, F.col("chunk_idx"))).alias("repeated"),
        F.count_if("differs").alias("not_source_text"),
        F.count_if(follows & (F.col("head") != F.col("tail"))).alias("overlap_differs"),
    )
    missing = F.col("due") - F.col("distinct") + F.col("extra") + F.col("repeated")
    counts = {c: F.col(c) for c in ("chunks", "neighbours", "wrong_length", "missing_or_extra", "not_source_text", "overlap_differs")}
    counts["missing_or_extra"] = missing
    lost = source.join(own.select("doc_id"), "doc_id", "left_anti").select(due.alias("missing_or_extra"))
    none = F.lit(0).cast("long")
    sums = [
        rows.agg(*(F.coalesce(F.sum(v), none).cast("long").alias(c) for c, v in parts.items()))
        for rows, parts in ((per_doc, counts), (lost, {c: F.col(c) if c in lost.columns else none for c in counts}))
    ]  # one row each
    return sums[0].unionByName(sums[1]).agg(*(F.sum(c).alias(c) for c in counts))


def stored_overlap(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """As ``operators.splitting.split_overlap``, from one stored table with a column ``split``; no row is moved."""
    sides = [F.max(F.when(F.col("split") == side, 1).otherwise(0)).alias(side) for side in ("train", "test")]
    per_key = rows.groupBy(*keys).agg(*sides)
    train, test = F.col("train") == 1, F.col("test") == 1
    return per_key.agg(
        F.count_if(train & ~test).alias("train_only"), F.count_if(~train & test).alias("test_only"), F.count_if(train & test).alias("on_both")
    )
