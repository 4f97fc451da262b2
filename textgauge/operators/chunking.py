"""Fixed-length windows over each document's tokens, their accounting and verification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from textgauge.functions.windows import (
    check_window,
    covered_tokens,
    div,
    window_count,
    windows_at,
)


def window_counts(
    df: DataFrame, length: Column, max_length: int, stride: int, key: str = "doc_id"
) -> DataFrame:
    """``(doc_id, n_tokens, n_windows)``."""
    n = df.select(key, length.cast("long").alias("n_tokens"))
    return n.withColumn("n_windows", window_count(F.col("n_tokens"), max_length, stride))


def chunk(
    df: DataFrame,
    max_length: int,
    stride: int | None = None,
    *,
    ids: str = "input_ids",
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """``(*keep, chunk_idx, start, input_ids)``; windows never cross documents.

    A document is cut into overlapping blocks of a few windows first, and the windows of a block are
    numbered and cut on rows of their own afterwards. So a small stride never holds all windows of a
    document at once, and a window row carries its block, not the document: the time stays linear in
    the length also where Spark compiles no code. The last cut is a generator, too: as a plain
    expression the optimizer could move it behind a shuffle or a UDF, which would then carry the
    block with each of its windows. Stride defaults to the length.
    """
    stride = max_length if stride is None else stride
    check_window(max_length, stride)
    # blocks of at least a window's reach overlap by half at most
    several = max(16, -(-max_length // stride))
    n = window_count(F.size(ids), max_length, stride)
    last = F.greatest(div(n + (several - 1), several) - 1, F.lit(0))
    reach = (several - 1) * stride + max_length
    # Guarded twice: sequence(0, -1) would run backwards.
    blocks = F.transform(
        F.sequence(F.lit(0), last), lambda b: F.slice(F.col(ids), b * (several * stride) + 1, F.lit(reach))
    )
    cut = df.select(*keep, F.posexplode(F.when(n > 0, blocks)).alias("_block", "_ids"))
    inside = window_count(F.size("_ids"), max_length, stride)
    numbers = F.when(inside > 0, F.sequence(F.lit(0), F.greatest(inside - 1, F.lit(0))))
    numbered = cut.select(*keep, "_block", "_ids", F.explode(numbers).alias("_w"))
    idx = F.col("_block") * several + F.col("_w")
    window = F.slice("_ids", F.col("_w") * stride + 1, F.lit(max_length))
    return numbered.select(
        *keep,
        idx.alias("chunk_idx"),
        (idx * stride).alias("start"),
        F.explode(F.array(window)).alias("input_ids"),
    )


def with_labels(df: DataFrame) -> DataFrame:
    """Labels equal the inputs (the shift happens in scoring); add them after shuffles and writes."""
    return df.withColumn("labels", F.col("input_ids"))


def chunk_stats(
    df: DataFrame, length: Column, max_length: int, stride: int, by: Sequence[str] = ()
) -> DataFrame:
    """Exact accounting from token lengths alone; no chunk is made.

    ``chunk_tokens`` counts tokens of overlapping windows repeatedly, ``covered_tokens`` once;
    ``dropped_tokens`` are in no window.
    """
    check_window(max_length, stride)
    sizes = df.select(*by, length.cast("long").alias("len"))
    n = window_count(F.col("len"), max_length, stride)
    covered = covered_tokens(F.col("len"), max_length, stride)
    return sizes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("docs"),
        F.count_if(F.col("len") < max_length).alias("short_docs"),
        F.sum(n).alias("chunks"),
        F.sum("len").alias("tokens"),
        (F.sum(n) * max_length).alias("chunk_tokens"),
        F.sum(covered).alias("covered_tokens"),
        F.sum(F.col("len") - covered).alias("dropped_tokens"),
    )


def chunk_coverage(
    df: DataFrame, length: Column, max_length: int, stride: int, by: Sequence[str] = ()
) -> DataFrame:
    """``(*by, windows, positions)``: how many token positions lie in 0, 1, 2, ... windows.

    Coverage follows from the length alone, so documents are first counted per length. It changes
    only where a window starts or ends, and between the first and the last windows it repeats with
    every stride. So a length gives the stretches of at most ``2 * (max_length // stride + 2)`` windows
    and two rows for the repeating part, however long it is.
    """
    check_window(max_length, stride)
    sizes = df.groupBy(*by, length.cast("long").alias("_len")).agg(F.count(F.lit(1)).alias("_docs"))
    n = window_count(F.col("_len"), max_length, stride)
    few = 2 * (max_length // stride + 2)
    sizes = sizes.select(*by, "_len", "_docs", n.alias("_n"), F.least(n, F.lit(few)).alias("_few"))
    starts = F.transform(F.sequence(F.lit(0), F.greatest(F.col("_few") - 1, F.lit(0))), lambda i: i * stride)
    edges = F.array_sort(F.array_distinct(F.concat(starts, F.transform(starts, lambda s: s + max_length))))
    edges = F.when(F.col("_few") > 0, edges).otherwise(F.array(F.lit(0)))
    covered = (F.col("_few") - 1) * stride + max_length
    stretches = F.transform(
        F.slice(edges, F.lit(2), F.size(edges)),
        lambda to, i: F.struct(
            windows_at(F.get(edges, i), covered, max_length, stride).cast("int").alias("windows"),
            (to - F.get(edges, i)).cast("long").alias("positions"),
        ),
    )
    level, more = divmod(max_length, stride)
    again = (F.col("_n") - F.col("_few")).cast("long")
    whole = F.when(F.col("_n") > 0, (F.col("_n") - 1).cast("long") * stride + max_length).otherwise(0)
    rest = F.array(
        *(
            F.struct(F.lit(w).alias("windows"), p.cast("long").alias("positions"))
            for w, p in ((level + 1, again * more), (level, again * (stride - more)), (0, F.col("_len") - whole))
        )
    )
    rows = sizes.select(*by, "_docs", F.inline(F.concat(stretches, rest))).filter("positions > 0")
    return rows.groupBy(*by, "windows").agg(F.sum(F.col("_docs") * F.col("positions")).alias("positions"))


#: Windows whose gaps are made together.
GAP_BLOCK = 4096


def uncovered(df: DataFrame, length: Column, max_length: int, stride: int, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``(*keys, from, to)``: the stretches of token positions that no window holds, ``to`` exclusive.

    Between windows that leave gaps, behind the last window, and the whole of a document without a window. They
    follow from the length alone and are made in blocks, so no row holds all gaps of a long document.
    """
    check_window(max_length, stride)
    size = F.coalesce(length, F.lit(0)).cast("long")
    n = window_count(size, max_length, stride).cast("long")
    rows = df.select(*keys, size.alias("_len"), n.alias("_n"))
    end = F.when(F.col("_n") > 0, (F.col("_n") - 1) * stride + max_length).otherwise(0)
    tail = F.array(F.struct(end.alias("from"), F.col("_len").alias("to")))
    if stride <= max_length:
        return rows.select(*keys, F.inline(tail)).filter(F.col("from") < F.col("to"))
    # block -1 is the tail
    blocks = F.sequence(F.lit(-1).cast("long"), F.greatest(div(F.col("_n") + (GAP_BLOCK - 2), GAP_BLOCK) - 1, F.lit(-1)))
    rows = rows.select("*", F.explode(blocks).alias("_b"))
    first = F.col("_b") * GAP_BLOCK
    last = F.least(first + GAP_BLOCK, F.col("_n") - 1) - 1
    gaps = F.transform(
        F.sequence(first, last), lambda i: F.struct((i * stride + max_length).alias("from"), ((i + 1) * stride).alias("to"))
    )
    made = F.when(F.col("_b") < 0, tail).otherwise(gaps)
    return rows.select(*keys, F.inline(made)).filter(F.col("from") < F.col("to"))


def verify_chunks(
    chunks: DataFrame, docs: DataFrame, max_length: int, stride: int, ids: str = "input_ids"
) -> DataFrame:
    """One row of counts; a sound chunk table has zero in the last four columns.

    ``docs`` holds the source ids under ``ids``. Chunks and source windows meet as hashes
    under ``(doc_id, chunk_idx)``, neighbours under the boundary between them, so the chunks of
    a huge document are spread over tasks and no token array is shuffled.
    """
    made = chunks.select(
        "doc_id",
        "chunk_idx",
        F.xxhash64(F.col("input_ids")).alias("hash"),
        (F.size("input_ids") != max_length).cast("int").alias("wrong"),
    )
    source = chunk(docs, max_length, stride, ids=ids).select(
        "doc_id", "chunk_idx", F.xxhash64(F.col("input_ids")).alias("hash"), F.lit(0).alias("wrong")
    )
    side = F.col("side")
    matched = (
        made.withColumn("side", F.lit(1))
        .unionByName(source.withColumn("side", F.lit(2)))
        .groupBy("doc_id", "chunk_idx")
        .agg(
            F.count_if(side == 1).alias("made"),
            F.count_if(side == 2).alias("due"),
            F.max(F.when(side == 1, F.col("hash"))).alias("a"),
            F.max(F.when(side == 2, F.col("hash"))).alias("b"),
            F.sum("wrong").alias("wrong"),
        )
        .agg(
            F.sum("made").alias("chunks"),
            F.sum("wrong").alias("wrong_length"),
            F.count_if(F.col("made") != F.col("due")).alias("missing_or_extra"),
            F.count_if((F.col("made") == 1) & (F.col("due") == 1) & (F.col("a") != F.col("b"))).alias(
                "not_source_text"
            ),
        )
    )
    shared = max(max_length - stride, 0)
    ids_col = F.col("input_ids")
    edges = chunks.select(
        "doc_id",
        F.inline(
            F.array(
                F.struct(
                    F.col("chunk_idx").alias("edge"),
                    F.lit("tail").alias("part"),
                    F.xxhash64(F.slice(ids_col, F.lit(stride + 1), F.lit(shared))).alias("hash"),
                ),
                F.struct(
                    (F.col("chunk_idx") - 1).alias("edge"),
                    F.lit("head").alias("part"),
                    F.xxhash64(F.slice(ids_col, F.lit(1), F.lit(shared))).alias("hash"),
                ),
            )
        ),
    )
    neighbours = (
        edges.groupBy("doc_id", "edge")
        .agg(
            F.max(F.when(F.col("part") == "tail", F.col("hash"))).alias("tail"),
            F.max(F.when(F.col("part") == "head", F.col("hash"))).alias("head"),
        )
        .agg(
            F.count_if(F.col("tail").isNotNull() & F.col("head").isNotNull()).alias("neighbours"),
            F.count_if(F.col("tail") != F.col("head")).alias("overlap_differs"),
        )
    )
    # two one-row results side by side
    names = {
        "chunks": matched,
        "neighbours": neighbours,
        "wrong_length": matched,
        "missing_or_extra": matched,
        "not_source_text": matched,
        "overlap_differs": neighbours,
    }
    matched, neighbours = (
        part.select(*[F.col(c) if p is part else F.lit(None).cast("long").alias(c) for c, p in names.items()])
        for part in (matched, neighbours)
    )
    return matched.unionByName(neighbours).agg(
        *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in names]
    )
