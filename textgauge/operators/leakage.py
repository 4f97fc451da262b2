"""Windows of one document that lie on both sides of a split, by the tokens they share.

Windows of one length overlap if their starts differ by less than that length. Every window is put in the one
or two bins of that length that it touches, so that an overlapping pair meets in a bin however long the document
is, and is counted in the bin where the later one starts. No row is made for a position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from textgauge.functions.windows import check_window, div

SIDES = ("train", "test")


def window_overlaps(
    train: DataFrame, test: DataFrame, max_length: int, keys: Sequence[str] = ("doc_id",), start: str = "start"
) -> DataFrame:
    """``(side, *keys, start, copies, pairs, shared_tokens)`` of every window that overlaps one of the other side.

    ``pairs`` counts the windows of the other side that it overlaps, repeated ones each; ``shared_tokens`` its own
    positions that any of them holds. Windows without a start or with a NULL key overlap nothing. Copies of a window count
    as one with a larger ``copies``.
    """
    check_window(max_length, max_length)
    both = [
        side.select(F.lit(name).alias("side"), *keys, F.col(start).cast("long").alias("start"))
        for name, side in zip(SIDES, (train, test))
    ]
    named = both[0].unionByName(both[1]).filter(F.col("start").isNotNull())
    windows = named.groupBy("side", *keys, "start").agg(F.count(F.lit(1)).alias("copies"))
    ends = F.array_distinct(F.array(div(F.col("start"), max_length), div(F.col("start") + (max_length - 1), max_length)))
    binned = windows.withColumn("bin", F.explode(ends))
    ours = binned.filter(F.col("side") == "train").select(*keys, "bin", F.col("start").alias("a"), F.col("copies").alias("n_a"))
    theirs = binned.filter(F.col("side") == "test").select(*keys, "bin", F.col("start").alias("b"), F.col("copies").alias("n_b"))
    near = F.abs(F.col("a") - F.col("b")) < max_length
    once = F.col("bin") == div(F.greatest("a", "b"), max_length)
    pairs = ours.join(theirs, [*keys, "bin"]).filter(near & once)
    each = pairs.select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.lit("train").alias("side"), F.col("a").alias("start"), F.col("b").alias("other"), F.col("n_a").alias("copies"), F.col("n_b").alias("n")),
                F.struct(F.lit("test").alias("side"), F.col("b").alias("start"), F.col("a").alias("other"), F.col("n_b").alias("copies"), F.col("n_a").alias("n")),
            )
        ),
    )
    # windows of one length cover a beginning or an end of each other, so the nearest on either side tell all
    before = F.max(F.when(F.col("other") <= F.col("start"), F.col("other")))
    after = F.min(F.when(F.col("other") >= F.col("start"), F.col("other")))
    found = each.groupBy("side", *keys, "start", "copies").agg(F.sum("n").alias("pairs"), before.alias("_b"), after.alias("_a"))
    head = F.coalesce(F.col("_b") + max_length - F.col("start"), F.lit(0))
    tail = F.coalesce(F.col("start") + max_length - F.col("_a"), F.lit(0))
    shared = F.least(head + tail, F.lit(max_length))
    return found.select("side", *keys, "start", "copies", "pairs", shared.cast("long").alias("shared_tokens"))


def window_leakage(
    train: DataFrame, test: DataFrame, max_length: int, keys: Sequence[str] = ("doc_id",), start: str = "start"
) -> DataFrame:
    """``(side, windows, leaking_windows, pairs, leaked_tokens)``, a row for each side.

    ``leaked_tokens`` counts a position once for every window of the side that holds it.
    """
    found = window_overlaps(train, test, max_length, keys, start).groupBy("side").agg(
        F.sum("copies").alias("leaking_windows"),
        F.sum(F.col("copies") * F.col("pairs")).alias("pairs"),
        F.sum(F.col("copies") * F.col("shared_tokens")).alias("leaked_tokens"),
    )
    sizes = [side.agg(F.count(F.lit(1)).alias("windows")).select(F.lit(name).alias("side"), "windows") for name, side in zip(SIDES, (train, test))]
    joined = sizes[0].unionByName(sizes[1]).join(found, "side", "left")
    none = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("leaking_windows", "pairs", "leaked_tokens")]
    return joined.select("side", "windows", *none)
