"""Best-fit packing of documents into bins of a fixed capacity, under conflicts.

Items are dealt out by hash into blocks of bounded size, and each block is packed by itself: the longest
item first, each into the fullest bin that has room and no conflict. Bins are kept ordered by what room
they have left; every bin carries bitmaps of its sources and duplicate clusters, and the search goes from
the tightest bin to the next until one is compatible. Only keys, sizes, sources and clusters are moved.

A bin takes at most one item of each source and of each duplicate cluster. A document longer than the
capacity is cut: full pieces are bins of their own, the rest is an item.

Defined results: every row is packed, repeated ones too. A null source or cluster conflicts with nothing.
A null size counts as 0, and an item of size 0 takes a place but no room. Equal sizes go by source hash
and row. Extra columns are left out.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from textgauge.llm.common import column, saved

#: Items of a block; bounds the memory and the search of a task.
ITEMS = 8192


class Bins:
    """Open bins ordered by the room they have left, with bitmaps of what they hold."""

    def __init__(self, capacity: int, items: int, sources: int, clusters: int):
        self.capacity = capacity
        self.room = np.zeros(0, np.int64)
        self.order = np.zeros(0, np.int64)
        self.maps = np.zeros((-(-(sources + clusters) // 64) or 1, items), np.uint64)
        self.count = 0

    def place(self, size: int, marks: list[int]) -> int:
        """Bin of an item; ``marks`` are the bits of its source and cluster."""
        at = int(np.searchsorted(self.room, size, "left"))
        words = [(m >> 6, np.uint64(1) << np.uint64(m & 63)) for m in marks]
        step, found = 64, -1
        while at < len(self.order):
            near = self.order[at : at + step]
            free = np.ones(len(near), bool)
            for word, bit in words:
                free &= (self.maps[word, near] & bit) == 0
            if free.any():
                found = at + int(free.argmax())
                break
            at, step = at + step, 4 * step
        if found < 0:
            bin_, left = self.count, self.capacity - size
            self.count += 1
        else:
            bin_, left = int(self.order[found]), int(self.room[found]) - size
            self.room, self.order = np.delete(self.room, found), np.delete(self.order, found)
        for word, bit in words:
            self.maps[word, bin_] |= bit
        to = int(np.searchsorted(self.room, left, "right"))
        self.room, self.order = np.insert(self.room, to, left), np.insert(self.order, to, bin_)
        return bin_


def pack_block(sizes: np.ndarray, sources: list, clusters: list, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(item, piece, length, bin, place) of a block's items, each given by its place in the arguments."""
    out, made = [], 0
    rest = sizes.copy()
    for i in np.flatnonzero(sizes > capacity):
        full = int((sizes[i] - 1) // capacity)
        out += [(int(i), piece, capacity, made + piece, 0) for piece in range(full)]
        made += full
        rest[i] -= full * capacity
    # a source or cluster that occurs once cannot conflict
    numbers: dict = {}
    for values, tag in ((sources, "s"), (clusters, "c")):
        for value, n in Counter(values).items():
            if n > 1 and value is not None:
                numbers[tag, value] = len(numbers)
    bins = Bins(capacity, len(sizes), len(numbers), 0)
    held: Counter = Counter()
    for i in np.argsort(-rest, kind="stable"):
        marks = [numbers[k] for k in (("s", sources[i]), ("c", clusters[i])) if k in numbers]
        bin_ = bins.place(int(rest[i]), marks)
        piece = int((sizes[i] - rest[i]) // capacity)
        out.append((int(i), piece, int(rest[i]), made + bin_, held[bin_]))
        held[bin_] += 1
    return out


def pack(docs: DataFrame, size: Column, cluster: Column, capacity: int, key: str = "doc_id", source: str = "source") -> DataFrame:
    """(key, piece, start, length, bin, place): where each piece of each document goes.

    ``size`` and ``cluster`` (any type that casts to string) are columns of ``docs``.
    """
    items = docs.select(
        column(docs, key).alias("key"),
        F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)).alias("size"),
        column(docs, source).cast("string").alias("source"),
        F.xxhash64(cluster.cast("string")).alias("cluster"),
        cluster.isNull().alias("alone"),
        F.monotonically_increasing_id().alias("row"),
    )
    items = saved(items, "items")
    blocks = max(1, -(-items.count() // ITEMS))
    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block")
    kind = docs.schema[key].dataType

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("row", kind="stable").reset_index(drop=True)
        clusters = [None if a else int(c) for a, c in zip(pdf["alone"], pdf["cluster"])]
        sources = [None if pd.isna(s) else s for s in pdf["source"]]
        made = pack_block(pdf["size"].to_numpy(np.int64), sources, clusters, capacity)
        item, piece, length, bin_, place = (np.array(x, np.int64) for x in zip(*made))
        return pd.DataFrame(
            {
                "row": pdf["row"].to_numpy()[item],
                "piece": piece.astype(np.int32),
                "start": piece * capacity,
                "length": length,
                "bin": (np.int64(pdf["block"].iloc[0]) << 32) + bin_,
                "place": place.astype(np.int32),
            }
        )

    fields = [("row", LongType()), ("piece", IntegerType()), ("start", LongType()), ("length", LongType()), ("bin", LongType()), ("place", IntegerType())]
    placed = items.select("row", "size", "source", "cluster", "alone", block).groupBy("block")
    placed = placed.applyInPandas(run, StructType([StructField(*f) for f in fields]))
    keys = items.select("row", F.col("key").alias(key))
    return placed.join(keys, "row").select(F.col(key).cast(kind), "piece", "start", "length", "bin", "place")
